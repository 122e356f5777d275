"""Readers: fixed-schema tables, delimited text, JSON and feed documents."""
