"""Training-data operators: mixing, deduplication, filtering, tokenising and media.

Nothing else in the library imports this subpackage.
"""
