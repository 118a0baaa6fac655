"""framelake.operators"""
