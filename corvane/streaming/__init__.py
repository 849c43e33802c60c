"""Streaming forms of operators that look at one row at a time."""
