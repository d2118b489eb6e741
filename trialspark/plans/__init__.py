"""plans of the trial engine."""
