"""threatframe.sources"""
