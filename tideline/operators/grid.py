"""Ticks to bars on a regular grid: aggregation, gap fill, concatenation, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ROWS, last_known, previous

PRICES, FLOWS = ("open", "high", "low", "close"), ("volume", "quote_volume", "trades", "taker_buy_base")


def bars_from_ticks(ticks: DataFrame, seconds: int) -> DataFrame:
    """ticks: series, us, id, price, volume, taker. OHLCV for each series and cell; ties in time by id.

    One shuffle on (series, cell) with partial aggregation; a hot series spreads over its cells."""
    at = F.struct("us", "id")
    cell = (F.floor(F.col("us") / (1_000_000 * seconds)) * seconds).cast("long")
    return ticks.groupBy("series", cell.alias("ts")).agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum("volume").alias("volume"),
        F.sum(F.col("price") * F.col("volume")).alias("quote_volume"),
        F.count("*").alias("trades"),
        F.sum("taker").alias("taker_buy_base"),
    )


def last_wins(rows: DataFrame, order: str) -> DataFrame:
    """One row for each (series, ts): the one with the greatest `order`."""
    rest = [c for c in rows.columns if c not in ("series", "ts", order)]
    return rows.groupBy("series", "ts").agg(F.max_by(F.struct(*rest), order).alias("r")).select("series", "ts", "r.*")


def on_grid(bars: DataFrame, seconds: int, shared: bool = False) -> DataFrame:
    """All cells from each series' first bar to its last (of all series, if shared): missing ones
    carry the last close as flat prices, no flow, and gap true. Adds row, the cell's number from 0.

    Cells are made block by block, and the last close is carried over blocks, so one series fills on many tasks."""
    ends = bars.groupBy("series").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.min_by("close", "ts").alias("first_close"))
    if shared:
        whole = ends.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))  # one row
        ends = ends.select("series", "first_close").crossJoin(F.broadcast(whole))
    last = F.floor((F.col("hi") - F.col("lo")) / seconds)
    blocks = ends.select("series", "lo", "first_close", last.alias("last"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / ROWS))).alias("block"))
    blocks = blocks.repartition("series", "block")
    row = F.explode(F.sequence(F.col("block") * ROWS, F.least(F.col("last"), (F.col("block") + 1) * ROWS - 1)))
    cells = blocks.select("series", "lo", "first_close", row.alias("row")).withColumn("ts", F.col("lo") + F.col("row") * seconds)
    joined = cells.join(bars, ["series", "ts"], "left").withColumn("gap", F.col("close").isNull())
    joined = last_known(joined, "series", "row", F.floor(F.col("row") / ROWS), "close")
    joined = joined.withColumn("close", F.coalesce("close", "first_close"))  # before a series' first bar, if shared
    joined = joined.withColumns({c: F.coalesce(c, "close") for c in ("open", "high", "low")})
    joined = joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in FLOWS})
    return joined.select("series", "ts", "row", *PRICES, *FLOWS, "gap")


def concat_parts(parts: list, seconds: int) -> DataFrame:
    """Bars of several parts on one grid; where they overlap the later part wins, holes are filled."""
    tagged = [p.withColumn("part", F.lit(k)) for k, p in enumerate(parts)]
    rows = tagged[0]
    for p in tagged[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    keep = ["series", "ts", *PRICES, *FLOWS]
    return on_grid(last_wins(rows.select(*keep, "part"), "part"), seconds)


def quality(bars: DataFrame, seconds: int) -> DataFrame:
    """Counts of violations and totals, a row for each series."""
    b = previous(bars, "series", "ts", F.floor(F.col("ts") / (seconds * ROWS)), "ts", "before")
    b = b.withColumn("step", F.col("ts") - F.col("before"))
    return b.groupBy("series").agg(
        F.count("*").alias("n_bars"),
        F.count_if(~(F.col("close") > 0)).alias("bad_closes"),
        F.count_if((F.col("low") > F.least("open", "close")) | (F.col("high") < F.greatest("open", "close"))).alias("bad_ohlc"),
        F.count_if(F.col("gap") & (F.col("volume") > 0)).alias("gap_with_volume"),
        F.count_if(F.col("step") != seconds).alias("breaks"),
        F.min("low").alias("min_price"),
        F.max("high").alias("max_price"),
        F.round(F.avg(F.col("gap").cast("int")), 6).alias("gap_ratio"),
    )
