"""Operators for preparing training corpora: filtering, deduplication, mixing and sharding.

Nothing outside this package imports it, so it can be removed as a whole.
"""
