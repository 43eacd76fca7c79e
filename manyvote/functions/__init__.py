"""Column expressions: hashing, type dispatch, voting."""
