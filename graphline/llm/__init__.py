"""Operators of a training-data pipeline: encoding, filtering, dedup, packing, archives.

Nothing outside this package imports it.
"""
