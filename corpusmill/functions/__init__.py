"""Column expressions and the few Arrow helpers."""
