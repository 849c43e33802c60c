"""Registered queries over the given tables, grouped by subject."""
