"""Derived tables, queries over them, and their SQL."""
