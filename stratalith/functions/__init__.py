"""Column expressions with exact semantics."""
