"""Preparation of text corpora. Nothing outside this subpackage imports it."""
