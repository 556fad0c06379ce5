"""Readers, writers and bar preparation."""
