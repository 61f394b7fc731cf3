"""Structured Streaming over newly landed games."""
