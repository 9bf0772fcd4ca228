"""Column-level functions: text analysis, value grids, descriptive statistics."""
