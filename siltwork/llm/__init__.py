"""Operators of a training-data pipeline: sharding, PII, dedup, extraction, packing.

Nothing outside this subpackage imports it.
"""
