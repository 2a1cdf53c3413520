"""Column expressions: text, numbers, vectors and JSON values."""
