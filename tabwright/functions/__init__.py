"""Column expressions: conditions, casts, and whole-column checks."""
