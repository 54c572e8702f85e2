"""Scans: event ticks, kline files, ranges, catalogues, calendars, synthetic tapes."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators.blocks import ROWS, previous, running_sum
from ..operators.grid import bars_from_ticks, last_wins, on_grid
from ..schema import KLINES, METRICS_SCHEMA


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of the events table: the type is the series, k of props the volume."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", "value", "props")
    volume = F.get_json_object("props", "$.k").cast("double")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("series"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("value").alias("price"),
        volume.alias("volume"),
        F.when(F.col("event_id") % 2 == 0, volume).otherwise(0.0).alias("taker"),
    )


def event_bars(spark: SparkSession, sf_dir: str, seconds: int = 3600) -> DataFrame:
    return bars_from_ticks(event_ticks(spark, sf_dir), seconds)


def event_grid(spark: SparkSession, sf_dir: str, seconds: int = 3600) -> DataFrame:
    return on_grid(event_bars(spark, sf_dir, seconds), seconds)


def _parsed(lines: DataFrame, series: str) -> DataFrame:
    """lines: line, at (their order). Klines have 10 to 12 fields, all that a bar needs readable; other lines are dropped."""
    read = lines.where(F.size(F.split("line", ",")).between(10, 12)).select(F.from_csv("line", KLINES, {"mode": "PERMISSIVE"}).alias("r"), "at")
    needed = ("open", "high", "low", "close", "volume", "quote_volume", "trades", "taker_buy_base")
    rows = read.select("r.*", "at").dropna(subset=["t", *needed])
    rows = rows.select(F.lit(series).alias("series"), s.epoch_seconds(F.col("t")).alias("ts"), *needed, F.col("at").alias("line"))
    return last_wins(rows, "line")


def klines(spark: SparkSession, paths, series: str) -> DataFrame:
    """Kline CSV files, with or without a header; malformed lines are dropped (a header is one, and lines of under 10 or over 12 fields), milliseconds
    and microseconds may mix. The last line of a second wins: by the place of the path in the list, file name, place in the file."""
    found = None
    for k, path in enumerate([paths] if isinstance(paths, str) else paths):
        one = spark.read.text(path).withColumnRenamed("value", "line")
        at = F.struct(F.lit(k).alias("k"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
        one = one.withColumn("at", at)
        found = one if found is None else found.unionByName(one)
    return _parsed(found.select("line", "at"), series)


def zipped_lines(spark: SparkSession, path) -> DataFrame:
    """path, member, line_no and line of all files in zip archives; an archive is unpacked by one task, member by member."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in sorted(z.namelist()):
                        lines = z.read(member).decode("utf-8", "replace").splitlines()
                        n = len(lines)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name] * n), pa.array([member] * n), pa.array(range(n), pa.int64()), pa.array(lines, pa.string())],
                            names=["path", "member", "line_no", "line"],
                        )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, member string, line_no long, line string")


def zipped_klines(spark: SparkSession, path, series: str) -> DataFrame:
    """Klines from zip archives, as klines() reads files."""
    lines = zipped_lines(spark, path)
    return _parsed(lines.select("line", F.struct("path", "member", "line_no").alias("at")), series)


def with_fallback(main: DataFrame, other: DataFrame, period="month") -> DataFrame:
    """main, and rows of other for the periods of which main has none: calendar months, or so many seconds."""
    key = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM") if period == "month" else F.floor(F.col("ts") / period)
    have = main.select("series", key.alias("p")).distinct()
    extra = other.withColumn("p", key).join(have, ["series", "p"], "left_anti").drop("p")
    return main.unionByName(extra)


def time_range(bars: DataFrame, lo: int, hi: int) -> DataFrame:
    """Bars with lo <= ts < hi; where the table is partitioned by month, that prunes too."""
    out = bars.where((F.col("ts") >= lo) & (F.col("ts") < hi))
    if "month" in bars.columns:
        name = lambda t: F.date_format(F.timestamp_seconds(F.lit(t)), "yyyy-MM")
        out = out.where((F.col("month") >= name(lo)) & (F.col("month") <= name(hi - 1)))
    return out


def clamped_range(bars: DataFrame, lo: int, hi: int) -> DataFrame:
    """Bars of [lo, hi) as far as the table goes; an error if there are none."""
    ends = bars.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    if ends.lo is None or max(lo, ends.lo) >= min(hi, ends.hi + 1):
        raise ValueError(f"no bars in [{lo}, {hi})")
    return time_range(bars, max(lo, ends.lo), min(hi, ends.hi + 1))


def prewarmed(bars: DataFrame, t_from: int, seconds: int, compute, warm: int = 7200, t_to: int | None = None) -> DataFrame:
    """compute(bars) from t_from on, over bars that begin `warm` cells earlier, so that recursions have settled. Each
    series is numbered from its first bar there."""
    d = bars.where(F.col("ts") >= t_from - warm * seconds)
    d = d if t_to is None else d.where(F.col("ts") < t_to)
    first = d.groupBy("series").agg(F.min("ts").alias("lo"))
    d = d.join(first, "series").withColumn("row", F.floor((F.col("ts") - F.col("lo")) / seconds).cast("long")).drop("lo")
    return compute(d).where(F.col("ts") >= t_from)


def feature_matrix(bars: DataFrame) -> DataFrame:
    """series, ts, row and x, the eight canonical columns as one array."""
    columns = ("open", "high", "low", "close", "volume", "quote_volume", "trades", "taker_buy_base")
    return bars.select("series", "ts", "row", F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))


def row_slice(bars: DataFrame, a: int, b: int) -> DataFrame:
    """Rows a to b - 1 of each series; what lies outside is left out."""
    return bars.where((F.col("row") >= max(0, a)) & (F.col("row") < b))


def history_before(bars: DataFrame, ts: int, n: int, seconds: int = 1) -> DataFrame:
    return time_range(bars, ts - max(1, n) * seconds, ts)


def catalogue(bars: DataFrame, period: str = "yyyy-MM-dd") -> DataFrame:
    """A row for each series and period: first second, rows."""
    name = F.date_format(F.timestamp_seconds("ts"), period)
    return bars.groupBy("series", name.alias("chunk")).agg(F.min("ts").alias("t0"), F.count("*").alias("n"))


def overlapping(chunks: DataFrame, ranges: DataFrame, seconds: int) -> DataFrame:
    """Pairs of chunks and ranges [lo, hi) that overlap. Chunks are found by the day: a range meets at most
    those of its days, so the join has a key."""
    days = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / 86400), F.floor((F.col(b) - 1) / 86400)))
    c = chunks.withColumn("t1", F.col("t0") + F.col("n") * seconds).withColumn("day", days("t0", "t1"))
    r = ranges.withColumn("day", days("lo", "hi"))
    hit = c.join(r, "day").where((F.col("t0") < F.col("hi")) & (F.col("t1") > F.col("lo")))
    return hit.drop("day", "t1").distinct()


def months(spark: SparkSession, first: str, last: str) -> DataFrame:
    """month, and its first and last-plus-one second, from first to last (yyyy-MM)."""
    day = lambda x: F.to_date(F.lit(f"{x}-01"))
    d = spark.range(1).select(F.explode(F.sequence(day(first), day(last), F.expr("interval 1 month"))).alias("d"))
    sec = lambda x: F.unix_timestamp(x.cast("timestamp"))
    return d.select(F.date_format("d", "yyyy-MM").alias("month"), sec(F.col("d")).alias("lo"), sec(F.add_months("d", 1)).alias("hi"))


def synthetic(spark: SparkSession, n: int, t0: int, series: str = "synthetic", seed: int = 7) -> DataFrame:
    """A random walk of n one-second bars with gaps, in cents."""
    d = spark.range(n).select(F.lit(series).alias("series"), (F.col("id") + t0).alias("ts"), F.col("id").alias("row"), F.randn(seed).alias("z"), F.rand(seed + 1).alias("u"), F.abs(F.randn(seed + 2)).alias("v"))
    block = F.floor(F.col("row") / ROWS)
    d = running_sum(d, "series", "row", block, "z", "walk").withColumn("close", F.bround(F.greatest(F.lit(1000.0), 30000 + 3 * F.col("walk")), 2))
    d = d.withColumn("gap", F.col("u") < 0.02).withColumn("volume", F.when(F.col("gap"), 0.0).otherwise(F.col("v") * 0.5))
    d = previous(d, "series", "row", block, "close", "last")
    last = F.col("last")
    return d.select(
        "series", "ts", "row", F.coalesce(last, "close").alias("open"), F.bround(F.greatest("close", F.coalesce(last, "close")) + F.col("v") * 0.4, 2).alias("high"),
        F.bround(F.least("close", F.coalesce(last, "close")) - F.col("v") * 0.4, 2).alias("low"), "close", "volume",
        (F.col("volume") * F.col("close")).alias("quote_volume"), (F.col("volume") * 20).cast("long").alias("trades"),
        (F.col("volume") * (0.2 + 0.6 * F.col("u"))).alias("taker_buy_base"), "gap",
    )


def metrics_csv(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(METRICS_SCHEMA).csv(path, header=True, enforceSchema=False)
