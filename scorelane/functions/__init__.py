"""Column functions: all are built-in expressions, none runs Python per row."""
