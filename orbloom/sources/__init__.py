"""orbloom.sources"""
