"""Plans of the change-data engine."""
