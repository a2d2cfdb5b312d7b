"""Column expressions and parameters."""
