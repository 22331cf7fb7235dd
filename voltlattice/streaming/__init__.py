"""Structured Streaming jobs over the same column library as batch."""
