"""Structured Streaming jobs over a folder or an event stream."""
