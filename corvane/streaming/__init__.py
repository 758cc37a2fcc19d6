"""Structured Streaming queries over event logs."""
