"""Sources of the change-data engine."""
