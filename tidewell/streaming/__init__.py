"""Structured Streaming twins of batch operators."""
