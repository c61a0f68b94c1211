"""Operators of a training-data pipeline: text encoding, deduplication, packing, scoring and search.

Nothing outside this subpackage imports it.
"""
