"""Column expressions and batched array kernels."""
