"""Structured Streaming jobs over the event stream."""
