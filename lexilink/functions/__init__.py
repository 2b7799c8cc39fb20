"""lexilink.functions"""
