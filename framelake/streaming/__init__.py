"""framelake.streaming"""
