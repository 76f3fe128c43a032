"""Operators over corpus tables, one module per family."""
