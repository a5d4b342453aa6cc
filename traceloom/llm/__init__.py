"""Operators for large text corpora: quality, deduplication, decontamination, packing.

Nothing outside this package imports it.
"""
