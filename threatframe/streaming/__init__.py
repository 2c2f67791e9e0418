"""threatframe.streaming"""
