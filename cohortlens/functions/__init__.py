"""Column expressions: special functions and value tokens."""
