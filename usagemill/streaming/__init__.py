"""Structured Streaming over usage logs: running reports and closed blocks."""
