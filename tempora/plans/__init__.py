"""tempora.plans"""
