"""The same stages on unbounded input."""
