"""Structured Streaming versions of the windowed scores."""
