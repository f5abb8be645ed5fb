"""Column expressions and order-aware building blocks."""
