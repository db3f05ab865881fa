"""Structured Streaming forms of the request operators."""
