"""streaming of the trial engine."""
