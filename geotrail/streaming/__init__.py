"""Continuous input over Structured Streaming."""
