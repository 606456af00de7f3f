"""Training-data operators: language ID, deduplication, quality, extraction, packing.

Nothing outside this subpackage imports it.
"""
