"""The same rules on unbounded input."""
