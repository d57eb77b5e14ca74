"""Operators for large text corpora used as training data; nothing else in the package needs them."""
