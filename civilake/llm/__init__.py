"""Operators for building training data from very large text corpora. Nothing else in the library imports them."""
