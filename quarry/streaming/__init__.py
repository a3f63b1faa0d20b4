"""Structured Streaming forms of the stateless and per-batch operators."""
