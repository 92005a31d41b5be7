"""Operators for large training-data corpora; queries.py registers them."""
