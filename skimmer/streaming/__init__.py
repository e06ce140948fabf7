"""Sketches over Structured Streaming."""
