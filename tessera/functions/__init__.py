"""Scalar functions: sizes, shuffle keys, categoricals."""
