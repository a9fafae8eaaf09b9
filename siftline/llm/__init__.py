"""Operators for building training data: one module each, one query each."""
