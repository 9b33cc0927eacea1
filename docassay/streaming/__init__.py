"""Structured Streaming over the same columns."""
