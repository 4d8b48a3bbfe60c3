"""Operators for large-scale training-data preparation over document tables."""
