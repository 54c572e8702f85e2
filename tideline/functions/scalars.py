"""Row-level expressions: rounding, prices and returns, clocks, guarded ratios, text bars."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))


def finite(x: Column) -> Column:
    """x, or 0 where it is null, NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.coalesce(x, F.lit(0.0)))


def log_price(price: Column) -> Column:
    return F.ln(F.greatest(price, F.lit(EPS)))


def returns_permille(now: Column, future: Column) -> Column:
    return 1000 * (log_price(future) - log_price(now))


def price_after(now: Column, permille: Column) -> Column:
    return now * F.exp(permille / 1000)


def sigma_price(now: Column, sigma: Column) -> Column:
    return now * (F.exp(sigma / 1000) - 1)


def error_bps(pred: Column, true: Column) -> Column:
    return F.abs(pred - true) / true * 10000


def vwap(volume: Column, quote_volume: Column, close: Column) -> Column:
    return F.when(volume > 0, quote_volume / F.greatest(volume, F.lit(EPS))).otherwise(close)


def taker_ratio(volume: Column, taker: Column, clipped: bool = False) -> Column:
    ratio = F.when(volume > 0, taker / F.greatest(volume, F.lit(EPS))).otherwise(0.5)
    return clip(ratio, 0, 1) if clipped else ratio


def range_permille(high: Column, low: Column, close: Column) -> Column:
    return (high - low) / F.greatest(close, F.lit(EPS)) * 1e3


def log1p(x: Column) -> Column:
    return F.ln(1 + x)


def phase(ts: Column, period: int, fn) -> Column:
    """sin or cos of the time's phase; the epoch has phase 0."""
    return fn(2 * math.pi * F.pmod(ts, F.lit(period)) / period)


def cents(price: Column) -> Column:
    """Fixed point with two digits, ties to even."""
    return F.bround(price * 100, 0).cast("long")


def even(x: Column, digits: int) -> Column:
    """Rounded, ties to even."""
    return F.bround(x, digits)


def epoch_seconds(t: Column) -> Column:
    """Seconds from milliseconds or, above 1e14, microseconds."""
    return F.when(t > 10**14, F.floor(t / 1_000_000)).otherwise(F.floor(t / 1000)).cast("long")


def progress(value: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return clip((value - lo) / max(hi - lo, EPS), 0, 1)


def text_bar(fraction: Column, width: int = 24, fill: str = "#", empty: str = "-") -> Column:
    n = F.bround(fraction * width, 0).cast("int")
    return F.concat(F.repeat(F.lit(fill), n), F.repeat(F.lit(empty), width - n))
