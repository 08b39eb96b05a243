"""Column functions: patterns, labels, series."""
