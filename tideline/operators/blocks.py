"""Windows over a whole series in two levels, so that one long series runs on many tasks.

Rows lie in blocks of a series. A block's summary (its last value, its sum, its end) is one row; a window over the
summaries gives each block what it starts with, and windows inside blocks do the rest. Summaries are fewer
than rows by the block's size, so their window stays small where the series is not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS = 4096


def _begun(df: DataFrame, key: str, block: Column, summary: dict, start) -> DataFrame:
    """df, dealt by (key, block_), with what start(window over earlier blocks) says of each block."""
    d = df.withColumn("block_", block).repartition(key, "block_")
    told = d.groupBy(key, "block_").agg(*[v.alias(k) for k, v in summary.items()])
    earlier = Window.partitionBy(key).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    told = told.select(key, "block_", start(earlier).alias("start_"))
    return d.join(told, [key, "block_"])


def _inside(key: str, order: str):
    return Window.partitionBy(key, "block_").orderBy(order)


def last_known(df: DataFrame, key: str, order: str, block: Column, column: str) -> DataFrame:
    """column, where null, takes the last value before."""
    d = _begun(df, key, block, {"end_": F.max_by(column, F.when(F.col(column).isNotNull(), F.col(order)))}, lambda w: F.last("end_", ignorenulls=True).over(w))
    past = _inside(key, order).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn(column, F.coalesce(F.last(column, ignorenulls=True).over(past), "start_")).drop("block_", "start_")


def previous(df: DataFrame, key: str, order: str, block: Column, column: str, name: str) -> DataFrame:
    """Adds name, the column's value in the row before; null in the first."""
    d = _begun(df, key, block, {"end_": F.max_by(column, order)}, lambda w: F.last("end_").over(w))
    return d.withColumn(name, F.coalesce(F.lag(column).over(_inside(key, order)), "start_")).drop("block_", "start_")


def running_sum(df: DataFrame, key: str, order: str, block: Column, column: str, name: str) -> DataFrame:
    """Adds name, the sum of column up to and with each row."""
    d = _begun(df, key, block, {"end_": F.sum(column)}, lambda w: F.sum("end_").over(w))
    past = _inside(key, order).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn(name, F.sum(column).over(past) + F.coalesce("start_", F.lit(0))).drop("block_", "start_")


def with_history(df: DataFrame, key: str, row: str, back: int, size: int = 4 * ROWS) -> tuple:
    """(rows, window, own): rows dealt into blocks, each with the `back` rows before it, so that what looks back
    no further can use the window; rows where own is true are the block's. size is at least back."""
    size = max(size, back)
    at = F.floor(F.col(row) / size)
    own = F.struct(at.alias("block_"), F.lit(True).alias("own_"))
    later = F.struct((at + 1).alias("block_"), F.lit(False).alias("own_"))
    both = F.when(F.col(row) % size >= size - back, F.array(own, later)).otherwise(F.array(own))
    d = df.withColumn("at_", F.explode(both)).select(*df.columns, "at_.block_", "at_.own_")
    return d, Window.partitionBy(key, "block_").orderBy(row), F.col("own_")
