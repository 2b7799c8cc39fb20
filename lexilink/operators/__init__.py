"""lexilink.operators"""
