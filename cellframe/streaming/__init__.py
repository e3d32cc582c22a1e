"""Structured Streaming forms of the tracker and of the time trend."""
