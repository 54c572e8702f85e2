"""Sources of the time-series engine."""
