"""orbloom.operators"""
