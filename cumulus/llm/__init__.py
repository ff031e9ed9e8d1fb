"""Operators for large-scale training-data pipelines (deduplication, mixing, filtering, packing).

An optional part: nothing else in the library imports it.
"""
