"""threatframe.sinks"""
