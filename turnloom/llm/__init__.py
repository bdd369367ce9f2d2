"""Operators for large-scale training-data work on conversation text. Nothing outside this package imports it."""
