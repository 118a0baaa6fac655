"""framelake.functions"""
