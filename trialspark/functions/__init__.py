"""functions of the trial engine."""
