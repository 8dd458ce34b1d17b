"""tempora.sources"""
