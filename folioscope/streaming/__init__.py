"""folioscope.streaming"""
