"""Streaming of the change-data engine."""
