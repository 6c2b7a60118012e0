"""Operators of the change-data engine."""
