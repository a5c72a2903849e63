"""Column expressions and Arrow-backed kernels."""
