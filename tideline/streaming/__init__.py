"""Streaming of the time-series engine."""
