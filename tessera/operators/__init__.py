"""Relational operators: alignment of feature spaces, interval lookup, sparse rows, checks."""
