"""Composed evaluation plans."""
