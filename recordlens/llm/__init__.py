"""Training-data operators: deduplication, quality, packing, mixing, scanning and search.

Nothing outside this subpackage imports it, so it can be removed whole.
"""
