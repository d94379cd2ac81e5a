"""Structured Streaming forms of the service tables."""
