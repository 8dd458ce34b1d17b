"""tempora.functions"""
