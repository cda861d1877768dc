"""Structured Streaming: the same analysis over files as they arrive."""
