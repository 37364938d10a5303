"""Streaming forms of the log operators; batch and stream agree on the final result."""
