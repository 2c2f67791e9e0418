"""threatframe.operators"""
