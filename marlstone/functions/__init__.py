"""Column-level building blocks: calendar, timestamps, numbers and text."""
