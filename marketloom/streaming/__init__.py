"""Structured Streaming jobs over event and trade streams."""
