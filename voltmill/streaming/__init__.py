"""Structured Streaming forms of the windowed statistics."""
