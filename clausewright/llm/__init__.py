"""Operators for large-scale training-text preparation; nothing outside this package imports it."""
