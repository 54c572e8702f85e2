"""Delayed labels, forecasts and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..schema import BEST_HIGH, BEST_LOW
from .ema import ema


def with_labels(rows: DataFrame, horizon: int) -> DataFrame:
    """Adds future_price, the close `horizon` rows later, and target; null past the end.

    An equi-join on (series, row): rows far apart need not meet in one sorted task."""
    later = rows.select("series", (F.col("row") - horizon).alias("row"), F.col("close").alias("future_price"))
    d = rows.join(later, ["series", "row"], "left")
    target = F.when(F.col("future_price").isNotNull(), s.returns_permille(F.col("close"), F.col("future_price")))
    return d.withColumn("target", target)


def linear(columns: dict, bias: float = 0.0) -> Column:
    out = F.lit(float(bias))
    for name, weight in columns.items():
        out = out + F.col(name) * float(weight)
    return out


def window_metrics(rows: DataFrame, keys: list, band_bps: float = 10.0, floor: float = 0.25, order: str = "row") -> DataFrame:
    """Scores of mu against target, price close and sigma, for each window; one shuffle. Rows without a target count in jitter,
    max_slew and sigma_mean alone; n is the number of rows that have one."""
    c = F.col
    w = Window.partitionBy(*keys).orderBy(order)
    err, y, p = c("mu") - c("target"), c("target"), c("mu")
    true = c("close") * F.exp(y / 1000)
    rel = F.abs(c("close") * F.exp(p / 1000) - true) / F.greatest(true, F.lit(1e-9))
    big = F.abs(y) > floor
    d = rows.withColumn("step", F.abs(p - F.lag("mu").over(w)))
    n, e2, y2 = F.count(y), F.sum(err * err), F.sum(y * y)
    spread = F.var_pop(y) * n
    skill = F.when(y2 > 0, 1 - e2 / F.when(y2 > 0, y2)).otherwise(0.0)
    r2 = F.when(spread > 1e-12, 1 - e2 / F.when(spread > 1e-12, spread)).otherwise(0.0)
    out = {
        "n": n,
        "mae": F.avg(F.abs(err)),
        "rmse": F.sqrt(F.avg(err * err)),
        "mape_pct": 100 * F.avg(rel),
        "band_accuracy": F.avg((rel <= band_bps / 10000).cast("double")),
        "direction_acc": F.coalesce(F.avg(F.when(big, ((p > 0) == (y > 0)).cast("double"))), F.lit(0.5)),
        "r2": r2,
        "skill_vs_naive": skill,
        "reward": F.avg(F.signum(p) * y * big.cast("double")),
        "bias": F.avg(err),
        "jitter": F.coalesce(F.avg("step"), F.lit(0.0)),
        "max_slew": F.coalesce(F.max("step"), F.lit(0.0)),
        "sigma_mean": F.avg(F.coalesce(c("sigma"), F.lit(1.0))),
        "calibration": F.avg((F.abs(err) / F.greatest(F.coalesce(c("sigma"), F.lit(1.0)), F.lit(1e-6)) <= 1).cast("double")),
    }
    return d.groupBy(*keys).agg(*[v.alias(k) for k, v in out.items()])


def running_best(rows: DataFrame, higher: list, lower: list, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = rows.withColumns({f"best_{c}": F.max(c).over(w) for c in higher})
    return d.withColumns({f"best_{c}": F.min(c).over(w) for c in lower})


def running_metrics(rows: DataFrame, names: list, key: str = "series", order: str = "row", span: float = 20, high=BEST_HIGH, low=BEST_LOW) -> DataFrame:
    """key, order and for each metric ema_<name>, its average seeded by its first value and left as it is by null and non-finite
    ones (null before the first), and best_<name>, the best average so far, where greater or lesser is better. Rows are
    numbered from 0 without holes, one for each window."""
    d = ema(rows, {f"ema_{n}": (F.col(n), span, F.lit(None)) for n in names}, key, order, carry=True)
    past = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    usable = lambda n: F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(F.col(n)) < float("inf"))
    d = d.withColumns({f"ema_{n}": F.when(F.max(usable(n)).over(past), F.col(f"ema_{n}")) for n in names})
    best = {f"best_{n}": (F.max if n in high else F.min)(f"ema_{n}").over(past) for n in names if n in high or n in low}
    return d.withColumns(best).select(key, order, *[f"ema_{n}" for n in names], *best)


def loss_terms(rows: DataFrame, keys: list, delta: float = 2.0, order: str = "row") -> DataFrame:
    """Huber, Gaussian likelihood and smoothness terms (first and second differences) of mu and log_sigma against target;
    differences stay inside a lane, so seams between lanes don't count."""
    c = F.col
    w = Window.partitionBy(*keys).orderBy(order)
    e = c("mu") - c("target")
    huber = F.when(F.abs(e) <= delta, 0.5 * e * e).otherwise(delta * (F.abs(e) - 0.5 * delta))
    ls = s.clip(c("log_sigma"), -4, 4)
    nll = ls + 0.5 * e * e * F.exp(-2 * ls)
    d = rows.withColumn("d1", c("mu") - F.lag("mu").over(w))
    d = d.withColumn("d2", c("d1") - F.lag("d1").over(w))
    return d.groupBy(*keys).agg(
        F.avg(huber).alias("huber"), F.avg(nll).alias("nll"), F.avg(c("d1") * c("d1")).alias("smooth"), F.avg(c("d2") * c("d2")).alias("curve")
    )
