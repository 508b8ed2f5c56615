"""Column functions: text, vectors, formats."""
