"""Scalar functions of the change-data engine."""
