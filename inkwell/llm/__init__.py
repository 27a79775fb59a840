"""Training-data operators: scanning, classification, deduplication, mixing, tokenising, vector search.

Nothing else in the library imports this subpackage.
"""
