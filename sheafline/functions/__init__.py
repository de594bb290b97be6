"""Column functions: text, vectors, dates."""
