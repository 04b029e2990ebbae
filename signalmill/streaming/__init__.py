"""Structured Streaming over signals."""
