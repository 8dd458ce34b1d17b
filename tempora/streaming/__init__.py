"""tempora.streaming"""
