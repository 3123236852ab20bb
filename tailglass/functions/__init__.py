"""Column functions: text, names, times."""
