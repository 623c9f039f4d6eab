"""Structured Streaming over the batch operators."""
