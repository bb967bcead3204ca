"""orbloom.functions"""
