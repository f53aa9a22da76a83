"""Column functions: text, vectors, names."""
