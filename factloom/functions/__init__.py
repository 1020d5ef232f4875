"""Scalar functions as Column expressions and plain Python helpers."""
