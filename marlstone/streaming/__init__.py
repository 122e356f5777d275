"""Structured Streaming forms of the weekly composites."""
