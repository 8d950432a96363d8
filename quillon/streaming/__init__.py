"""Structured Streaming editions."""
