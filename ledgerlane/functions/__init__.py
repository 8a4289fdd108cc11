"""Column expressions, header rules and fixed values."""
