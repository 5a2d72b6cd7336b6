"""Evaluation of machine-given scores on Spark DataFrames."""
