"""Continuous queries on streams."""
