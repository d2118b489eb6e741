"""operators of the trial engine."""
