"""Scalar functions: Columns in, Columns out, all on built-in expressions."""
