"""Operators of a training-data pipeline: quality, deduplication, mixing, tokens, models.

Nothing outside this subpackage imports it.
"""
