"""Distributed operators over bar tables and result tables."""
