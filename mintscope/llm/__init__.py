"""Training-data operators: parsing, deduplication, filtering, mixing and packing of text and vectors.

Nothing else in the library imports this subpackage.
"""
