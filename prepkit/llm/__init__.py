"""Operators for preparing text corpora: scoring, filtering, deduplication, scanning and packing.

Nothing else in the library imports this package.
"""
