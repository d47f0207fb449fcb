"""Operators for training data; the rest of the library does not import them."""
