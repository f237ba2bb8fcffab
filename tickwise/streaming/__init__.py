"""Structured Streaming entry points; they share the batch operators."""
