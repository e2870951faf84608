"""Streams over graphs."""
