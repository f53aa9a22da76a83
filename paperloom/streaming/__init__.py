"""Structured Streaming forms of operators that need no second pass over the data."""
