"""Operators that make training data out of raw documents."""
