"""Operators for large text corpora: extraction, packing, deduplication, scoring.

Nothing else in the library imports this subpackage.
"""
