"""The same blocks over streams."""
