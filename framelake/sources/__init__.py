"""framelake.sources"""
