"""Batch operators on tuple tables."""
