"""lexilink.streaming"""
