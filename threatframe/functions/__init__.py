"""threatframe.functions"""
