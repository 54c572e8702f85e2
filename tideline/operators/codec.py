"""The compact form of bars: price deltas and offsets in cents, fixed-point volume, capped counts, a
ratio byte. Written as Parquet, whose delta and bit packing then have small integers to work on. Deltas
begin anew in each chunk of `chunk` rows, so chunks are coded and decoded alone, and side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as s

#: Fixed values of the format.
PRICE_SCALE, VOLUME_SCALE, TRADES_CAP, RATIO_SCALE, OFFSET_CAP = 100, 10_000, 65_535, 255, 2_000_000_000
INT_MAX = 2_147_483_647
CHUNK = 86_400


def _chunks(chunk: int):
    return Window.partitionBy("series", F.floor(F.col("row") / chunk)).orderBy("row")


def encode(bars: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """series, ts, row and the encoded columns; values outside 32 bits raise."""
    w = _chunks(chunk)
    d = bars.withColumns({f"{c}_c": s.cents(F.col(c)) for c in ("open", "high", "low", "close")})
    d = d.withColumn("volume_i", F.bround(F.col("volume") * VOLUME_SCALE, 0).cast("long"))
    off = F.bround((s.vwap(F.col("volume"), F.col("quote_volume"), F.col("close")) - F.col("close_c") / PRICE_SCALE) * PRICE_SCALE, 0)
    ratio = s.taker_ratio(F.col("volume"), F.col("taker_buy_base"), clipped=True)
    out = d.select(
        "series", "ts", "row",
        (F.col("close_c") - F.coalesce(F.lag("close_c").over(w), F.lit(0))).alias("close_delta"),
        (F.col("open_c") - F.col("close_c")).alias("open_off"),
        (F.col("high_c") - F.col("close_c")).alias("high_off"),
        (F.col("low_c") - F.col("close_c")).alias("low_off"),
        s.clip(off, -OFFSET_CAP, OFFSET_CAP).cast("long").alias("vwap_off"),
        "volume_i",
        F.least(F.col("trades"), F.lit(TRADES_CAP)).cast("int").alias("trades_u16"),
        F.bround(ratio * RATIO_SCALE, 0).cast("int").alias("tb_ratio_u8"),
        "gap",
    )
    for c in ("close_delta", "open_off", "high_off", "low_off", "volume_i"):
        bad = F.raise_error(F.concat(F.lit(f"{c} needs more than 32 bits: "), F.col(c).cast("string")))
        out = out.withColumn(c, F.when(F.abs(c) > INT_MAX, bad).otherwise(F.col(c)).cast("int"))
    return out


def decode(coded: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Bars again: prices exact to the cent. chunk is that of encode."""
    w = _chunks(chunk).rowsBetween(Window.unboundedPreceding, 0)
    d = coded.withColumn("c", F.sum("close_delta").over(w))
    volume = F.col("volume_i") / VOLUME_SCALE
    return d.select(
        "series", "ts", "row",
        *[((F.col("c") + F.col(f"{p}_off")) / PRICE_SCALE).alias(p) for p in ("open", "high", "low")],
        (F.col("c") / PRICE_SCALE).alias("close"),
        volume.alias("volume"),
        (volume * (F.col("c") / PRICE_SCALE + F.col("vwap_off") / PRICE_SCALE)).alias("quote_volume"),
        F.col("trades_u16").cast("long").alias("trades"),
        (volume * F.col("tb_ratio_u8") / RATIO_SCALE).alias("taker_buy_base"),
        "gap",
    )
