"""tempora.operators"""
