"""Operators that prepare records for model training. Nothing outside this package imports it."""
