"""Column functions: text, hashing, vectors, dates."""
