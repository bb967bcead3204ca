"""orbloom.streaming"""
