"""Sinks of the change-data engine."""
