"""Operators of the time-series engine."""
