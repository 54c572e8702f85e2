"""Functions of the time-series engine."""
