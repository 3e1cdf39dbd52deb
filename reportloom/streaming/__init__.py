"""Structured Streaming forms of the stateless stages."""
