"""Column expressions and Arrow-batched scalar functions."""
