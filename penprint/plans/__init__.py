"""Document views and feature blocks."""
