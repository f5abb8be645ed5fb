"""The slot metrics on unbounded input."""
