"""Column-level helpers: exact arithmetic, time keys, hash keys, text extraction."""
