"""Column functions: numbers, geometry, text and formatting."""
