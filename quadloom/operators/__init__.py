"""Data-processing operators of the core."""
