"""Tumbling windows, splits, lanes, shards, thinning and matching over gridded series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import ROWS, previous, running_sum


def window_id(size: int, row: str = "row") -> Column:
    return F.floor(F.col(row) / size).cast("long")


def full_windows(bars: DataFrame, size: int, stride: int = 1) -> DataFrame:
    """Rows of whole tumbling windows, with window_id; a partial tail is dropped. Every stride-th
    window is taken."""
    d = bars.withColumn("window_id", window_id(size))
    last = bars.groupBy("series").agg((F.max("row") + 1).alias("n"))
    d = d.join(last, "series").where((F.col("window_id") + 1) * size <= F.col("n")).drop("n")
    return d.where(F.col("window_id") % stride == 0) if stride > 1 else d


def epochs(rows: DataFrame, seconds: int) -> DataFrame:
    """Adds epoch, how many discontinuities lie before a row: recursions start anew in each."""
    block = F.floor(F.col("ts") / (seconds * ROWS))
    d = previous(rows, "series", "ts", block, "ts", "before")
    d = d.withColumn("jump", F.coalesce((F.col("ts") - F.col("before") != seconds).cast("int"), F.lit(0)))
    return running_sum(d, "series", "ts", block, "jump", "epoch").drop("jump", "before")


def per_epoch(rows: DataFrame, seconds: int) -> DataFrame:
    """Rows of a series with discontinuities as one series for each epoch, series#epoch, numbered anew from 0: what
    recurs over these, EMAs, labels, filters, begins again after each discontinuity, and nothing pends across it."""
    d = epochs(rows, seconds)
    first = d.groupBy("series", "epoch").agg(F.min("ts").alias("lo"))
    d = d.join(first, ["series", "epoch"]).withColumn("row", F.floor((F.col("ts") - F.col("lo")) / seconds).cast("long"))
    return d.withColumn("series", F.concat_ws("#", "series", "epoch")).drop("epoch", "lo")


def split_eval(bars: DataFrame, fraction: float, size: int, seconds: int) -> DataFrame:
    """Adds part, train or eval: the newest fraction of each series' time, cut at a window's border."""
    ends = bars.groupBy("series").agg(F.min("ts").alias("lo"), (F.max("ts") + seconds).alias("hi"))
    cut = F.col("hi") - F.floor((F.col("hi") - F.col("lo")) * fraction).cast("long")
    ends = ends.withColumn("cut", cut).withColumn("cut", F.col("cut") - F.col("cut") % (size * seconds))
    d = bars.join(ends, "series")
    return d.withColumn("part", F.when(F.col("ts") < F.col("cut"), "train").otherwise("eval")).drop("lo", "hi", "cut")


def lanes(bars: DataFrame, n: int, size: int) -> DataFrame:
    """Adds lane: contiguous segments of whole windows of each series, n of them, or fewer where a
    segment would have under four windows. What is left over, and lanes of under two windows, go;
    a series that is left without any is one lane."""
    c, w = F.col, F.lit(size)
    ends = bars.groupBy("series").agg((F.max("row") + 1).alias("n"))
    whole = lambda x: x - x % w
    ends = ends.withColumn("segment", whole(F.floor(c("n") / n)))
    few = F.greatest(F.lit(1), F.floor(c("n") / (size * 4)))
    small = c("segment") < size * 4
    ends = ends.withColumn("count", F.when(small, few).otherwise(n))
    ends = ends.withColumn("segment", F.when(small, F.greatest(w * 2, whole(F.floor(c("n") / few)))).otherwise(c("segment")))
    d = bars.join(ends, "series").withColumn("lane", F.floor(c("row") / c("segment")).cast("int"))
    length = F.least(c("n"), (c("lane") + 1) * c("segment")) - c("lane") * c("segment")
    alone = c("n") < size * 2
    d = d.where(alone | ((c("lane") < c("count")) & (length >= size * 2)))
    return d.withColumn("lane", F.when(alone, 0).otherwise(c("lane"))).drop("n", "segment", "count")


def round_robin(rows: DataFrame, world: int, block: int) -> DataFrame:
    """Adds rank: blocks of windows dealt in turn."""
    return rows.withColumn("rank", F.pmod(F.floor(F.col("window_id") / block), F.lit(world)).cast("int"))


def thin(rows: DataFrame, every: int) -> DataFrame:
    return rows.where(F.col("row") % every == 0)


def newest_windows(rows: DataFrame, n: int) -> DataFrame:
    """Rows of the newest n windows of each series."""
    top = rows.groupBy("series").agg(F.max("window_id").alias("top"))
    d = rows.join(top, "series")  # windows are numbered without holes
    return d.where(F.col("window_id") > F.col("top") - n).drop("top")


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """For each row of left the value of right that is nearest in `at`, of equally near ones the
    earlier; a union sorted once, not a cross join."""
    a = left.select("*", F.lit(1).alias("is_left"), F.lit(None).cast("long").alias("m_at"), F.lit(None).cast(right.schema[value].dataType).alias("m_value"))
    b = right.select(key, at, F.lit(0).alias("is_left"), F.col(at).alias("m_at"), F.col(value).alias("m_value"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "is_left")
    hit = F.when(F.col("is_left") == 0, F.struct(F.col("m_at").alias("at"), F.col("m_value").alias("value")))
    both = both.withColumn("before", F.last(hit, True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("after", F.first(hit, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    use = F.when(F.col("after").isNull() | (F.col(at) - F.col("before.at") <= F.col("after.at") - F.col(at)), F.col("before")).otherwise(F.col("after"))
    return both.where("is_left = 1").withColumn(f"nearest_{value}", use["value"]).select(*left.columns, f"nearest_{value}")
