"""Incremental coding of arriving files."""
