"""Operators for training-data corpora. Nothing else in this library imports them."""
