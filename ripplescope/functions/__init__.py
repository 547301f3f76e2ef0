"""Column expressions for paths, names and text."""
