"""lexilink.plans"""
