"""Structured Streaming twins of the cache and the response summary."""
