"""Column expressions and ordered-prefix helpers."""
