"""orbloom.plans"""
