"""Append-only inputs as streams."""
