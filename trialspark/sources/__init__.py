"""sources of the trial engine."""
