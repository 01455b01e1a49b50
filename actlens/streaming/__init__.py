"""Structured Streaming forms of the incremental plans."""
