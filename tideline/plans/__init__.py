"""Query plans of the time-series engine, by name, and their SQL."""

from . import catalogue, learning, stores, streams  # noqa: F401  these add their queries to the catalogue


def queries() -> dict:
    return dict(catalogue.QUERIES)


def oracle_sql() -> dict:
    return dict(catalogue.ORACLES)
