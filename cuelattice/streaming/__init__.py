"""Structured Streaming twins of the operators that carry state."""
