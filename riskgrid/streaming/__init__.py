"""Structured Streaming forms of the grid features (an extension: the
reference has no streaming)."""
