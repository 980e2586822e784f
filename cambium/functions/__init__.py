"""Column expressions and fixed lookup tables."""
