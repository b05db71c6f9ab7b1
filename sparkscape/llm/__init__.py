"""Operators for corpora of training text; nothing outside this package imports them."""
