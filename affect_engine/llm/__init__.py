"""Operators of a training-data pipeline, one module each.

Nothing outside this package imports it. ``queries`` holds the registered
queries and their SQL, ``words`` the byte-level word helpers for Arrow batches,
``tables`` the lineage and graph helpers.
"""
