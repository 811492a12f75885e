"""Structured Streaming scoring (SC6)."""
