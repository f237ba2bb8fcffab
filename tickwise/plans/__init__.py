"""Composed user queries built from the operators."""
