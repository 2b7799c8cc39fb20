"""lexilink.sources"""
