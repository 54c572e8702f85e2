"""Data frames behind charts: the trailing view, smoothed curves with robust limits, thinned payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from .ema import ema


def trailing(rows: DataFrame, cells: int, horizon_seconds: int) -> DataFrame:
    """The newest `cells` rows of each series: price, the forecast shifted to when it falls due, its band, and the
    error in per mille once known. rows: series, row, ts, close, mu, sigma, target."""
    top = rows.groupBy("series").agg(F.max("row").alias("top"))
    pred, band = s.price_after(F.col("close"), F.col("mu")), s.sigma_price(F.col("close"), F.col("sigma"))
    return rows.join(top, "series").where(F.col("row") > F.col("top") - cells).select(
        "series", "ts", "close", (F.col("ts") + horizon_seconds).alias("due_ts"), pred.alias("pred_price"),
        (pred - band).alias("lo"), (pred + band).alias("hi"), (F.col("mu") - F.col("target")).alias("error_permille"),
    )


def curves(metrics: DataFrame, names: list, span: int = 40) -> DataFrame:
    """Each metric with its display average and the series' 1 % and 99 % limits; missing values leave the average as it
    is. metrics: series, row."""
    d = ema(metrics, {f"ema_{n}": (F.col(n), span, F.lit(None)) for n in names}, carry=True)
    limits = metrics.groupBy("series").agg(*[F.percentile(n, F.array(F.lit(0.01), F.lit(0.99))).alias(f"q_{n}") for n in names])
    d = d.join(limits, "series")
    for n in names:
        d = d.withColumn(f"lo_{n}", F.col(f"q_{n}")[0]).withColumn(f"hi_{n}", F.col(f"q_{n}")[1])
    return d.select("series", "row", *[c for n in names for c in (n, f"ema_{n}", f"lo_{n}", f"hi_{n}")])


def payload(rows: DataFrame, columns: list, most: int = 6000) -> DataFrame:
    """One JSON document for each series, of every k-th row so that at most about `most` remain."""
    n = rows.groupBy("series").agg(F.count("*").alias("n"))
    d = rows.join(n, "series").where(F.col("row") % F.greatest(F.lit(1), F.ceil(F.col("n") / most)) == 0)
    points = F.sort_array(F.collect_list(F.struct("ts", *columns)))
    return d.groupBy("series").agg(F.to_json(points).alias("points"), F.count("*").alias("n_points"))
