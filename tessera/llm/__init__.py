"""Operators for building training data: quality, duplicates, leaks, secrets, shards, packing, token files.

Nothing outside this package imports it. Each module is one operator and has
its own general interface; ``queries`` registers one job per operator.
"""
