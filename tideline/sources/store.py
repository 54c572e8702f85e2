"""Sinks and run stores: bars by month, the prediction tape, metrics, run documents, checkpoints."""

from __future__ import annotations

import json
import time
import uuid

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import sigma_price
from ..schema import TAPE, WAREHOUSE_METRICS


def write_bars(bars: DataFrame, path: str) -> None:
    """Parquet by month, each file sorted by time; the commit is atomic."""
    d = bars.withColumn("month", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM"))
    d.repartition("month", "series").sortWithinPartitions("month", "series", "ts").write.mode("overwrite").option("compression", "zstd").partitionBy("month").parquet(path)


def write_manifest(bars: DataFrame, path: str, seconds: int, extra: dict | None = None) -> None:
    """One JSON document: totals, columns, and an array of chunks with their bytes. bars is a table as write_bars wrote it."""
    size = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b"))
    files = bars.select("series", "month", "ts", size.alias("file")).groupBy("series", "month", "file").agg(F.min("ts").alias("t0"), F.count("*").alias("n"))
    chunks = files.groupBy("series", "month").agg(F.min("t0").alias("t0"), F.sum("n").alias("n"), F.sum("file.b").alias("bytes"))
    one = chunks.agg(
        F.count("*").alias("n_chunks"), F.sum("n").alias("n_seconds"), F.min("t0").alias("t_start"), F.max(F.col("t0") + F.col("n") * seconds).alias("t_end"),
        F.sum("bytes").alias("bytes"), F.sort_array(F.collect_list(F.struct("t0", "n", "series", "month", "bytes"))).alias("chunks"),
    )
    one = one.withColumn("columns", F.array(*[F.lit(c) for c in bars.columns]))
    one.withColumns({k: F.lit(v) for k, v in (extra or {}).items()}).coalesce(1).write.mode("overwrite").json(path)


def rebuild_manifest(spark: SparkSession, bars_path: str, path: str, seconds: int, extra: dict | None = None) -> None:
    """The catalogue of what lies at bars_path; files that can't be read are left out."""
    write_manifest(spark.read.option("ignoreCorruptFiles", "true").option("mergeSchema", "true").parquet(bars_path), path, seconds, extra)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue; an error if there is none, or none of its chunks."""
    try:
        d = spark.read.json(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"no catalogue: {path}") from e
    if "chunks" not in d.columns or d.where(F.size("chunks") > 0).limit(1).count() == 0:
        raise ValueError(f"empty catalogue: {path}")
    return d


def describe(spark: SparkSession, path: str) -> DataFrame:
    """Days, bars, MB and bounds of a catalogue."""
    chunks = read_manifest(spark, path).select(F.explode("chunks").alias("c"), "t_end").select("c.*", "t_end")
    return chunks.agg(
        F.count("*").alias("n_chunks"), F.sum("n").alias("bars"), F.round(F.sum("bytes") / 1e6, 6).alias("mb"),
        F.timestamp_seconds(F.min("t0")).alias("first"), F.timestamp_seconds(F.max("t_end")).alias("end"),
        F.round((F.max("t_end") - F.min("t0")) / 86400, 6).alias("days"),
    )


def files(spark: SparkSession, path: str, pattern: str = "") -> DataFrame:
    """path, name, bytes and modified of all files below path whose names have the pattern, a regular expression."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return d.select("path", name.alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")).where(name.rlike(pattern))


def store_size(spark: SparkSession, path: str, pattern: str = "") -> DataFrame:
    return files(spark, path, pattern).agg(F.count("*").alias("n_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def newest_run(spark: SparkSession, root: str, document: str = "live.json") -> str | None:
    """The run below root whose live document was written last."""
    runs = files(spark, root).withColumn("run", F.regexp_extract("path", rf"/([^/]+)/{document}(?:/[^/]*)?$", 1)).where("run <> ''")
    return runs.agg(F.max_by("run", "modified")).first()[0]


def files_by_year(names: DataFrame, column: str = "name") -> DataFrame:
    """year, and the sorted names that have it; names without a year are left out."""
    d = names.withColumn("year", F.regexp_extract(column, r"((?:19|20)[0-9]{2})", 1)).where("year <> ''")
    return d.groupBy(F.col("year").cast("int").alias("year")).agg(F.sort_array(F.collect_list(column)).alias("names"))


def named_windows(names: DataFrame, column: str = "name") -> DataFrame:
    """Adds window_id, lane and rank, read from names such as w00001002_r1: the number is window_id * 1000 + lane."""
    number = F.regexp_extract(column, r"w(\d+)", 1).cast("long")
    rank = F.regexp_extract(column, r"_r(\d+)", 1)
    return names.withColumns({"window_id": F.floor(number / 1000), "lane": (number % 1000).cast("int"), "rank": F.when(rank != "", rank.cast("int")).otherwise(0)})


def copy_files(spark: SparkSession, source: str, target: str, pattern: str = "", replace: bool = False) -> int:
    """Copies the files below source whose names have the pattern into the folder target, by Hadoop's file systems, from and
    to any store; those that are there stay as they are, unless replace. Gives the number copied."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    to = path(target).getFileSystem(conf)
    to.mkdirs(path(target))
    have = set() if replace else {f.getPath().getName() for f in to.listStatus(path(target))}
    copied = 0
    for r in files(spark, source, pattern).select("path", "name").toLocalIterator():
        if r.name not in have:
            at = path(r.path)
            jvm.org.apache.hadoop.fs.FileUtil.copy(at.getFileSystem(conf), at, to, path(f"{target}/{r.name}"), False, True, conf)
            copied += 1
    return copied


def put_file(spark: SparkSession, source: str, target: str) -> None:
    """Puts the file source in the place of target by one rename, so that readers find the one or the other, whole, on file systems
    with such a rename (local ones and HDFS)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    files = hadoop.Path(target).getFileSystem(conf)
    at, to = files.makeQualified(hadoop.Path(source)), files.makeQualified(hadoop.Path(target))
    if to.toUri().getScheme() == "file":  # with checksums, which stand in a file of their own, a local rename isn't one step
        if not files.getRawFileSystem().rename(at, to):
            raise OSError(f"{target} can't be replaced")
        return
    options = getattr(hadoop, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(options, 1)
    how[0] = options.OVERWRITE
    hadoop.FileContext.getFileContext(to.toUri(), conf).rename(at, to, how)


def put_document(rows: DataFrame, target: str, form: str = "json") -> None:
    """rows, few, as one file at target; it is written beside it first, and an older version stays until the new one is whole."""
    spark = rows.sparkSession
    beside = f"{target}.{uuid.uuid4().hex}"
    rows.coalesce(1).write.format(form).save(beside)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(beside).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = [f.getPath().toString() for f in files.listStatus(path(beside)) if f.getPath().getName().startswith("part-")]
    if part:
        put_file(spark, part[0], target)
    files.delete(path(beside), True)


class RunStore:
    """Tables of one run below a folder: tape (by window), metrics, checkpoints, documents."""

    def __init__(self, spark: SparkSession, root: str, run_id: str):
        self.spark, self.run_id, self.root = spark, run_id, f"{root}/{run_id}"

    def save_windows(self, rows: DataFrame) -> None:
        """Upsert by window: the windows that rows hold replace their earlier files, others stay."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("window_id").parquet(f"{self.root}/tape")

    def tape(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/tape")

    def series(self, last: int | None = None, **where) -> DataFrame:
        """The tape in time order; equality filters such as lane or rank, and the newest `last` windows. Where it has sigma,
        sigma_price is that in units of the price."""
        d = self.tape()
        if {"sigma", "price_now"} <= set(d.columns):
            d = d.withColumn("sigma_price", sigma_price(F.col("price_now"), F.col("sigma")))
        for k, v in where.items():
            d = d.where(F.col(k) == v)
        if last is not None:
            ids = d.select("window_id").distinct()
            d = d.join(ids.withColumn("k", F.row_number().over(Window.orderBy(F.desc("window_id")))).where(F.col("k") <= last).drop("k"), "window_id")
        return d.orderBy("ts")

    def consolidate(self, path: str) -> str:
        """The tape as one table of sorted files, each a range of windows; columns that some windows lack are null there."""
        d = self.tape().withColumn("run_id", F.lit(self.run_id)).repartitionByRange("window_id", "ts")
        d.sortWithinPartitions("window_id", "ts").write.mode("overwrite").option("compression", "zstd").parquet(path)
        return path

    def windows(self, start: int = 0, most: int | None = None, seconds: float | None = None):
        """Windows of the tape from the start-th on, one frame each, at most `most` of them and for `seconds` at the longest."""
        began = time.monotonic()
        ids = sorted(r.window_id for r in self.tape().select("window_id").distinct().toLocalIterator())[start:]
        for k in ids[:most]:
            if seconds is not None and time.monotonic() - began >= seconds:
                return
            yield self.tape().where(F.col("window_id") == k).orderBy("ts")

    def latest(self, lane: str = "lane") -> DataFrame:
        """The rows of each lane's newest window."""
        d = self.tape()
        top = d.groupBy(lane).agg(F.max("window_id").alias("top"))
        return d.join(top, lane).where(F.col("window_id") == F.col("top")).drop("top")

    def write_live(self, values: dict, every: int = 1) -> None:
        """The live document: values, and the newest window, every so many rows, of each lane."""
        w = Window.partitionBy("lane").orderBy("ts")
        d = self.latest().withColumn("k", F.row_number().over(w) - 1).where(F.col("k") % every == 0).drop("k")
        rows = [{k: v for k, v in r.asDict().items() if v is not None} for r in d.orderBy("lane", "ts").toLocalIterator()]
        self.write_document("live.json", {**values, "run_id": self.run_id, "rows": rows})

    def append_metrics(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.root}/metrics")

    def metrics(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/metrics")

    def write_document(self, name: str, payload: dict) -> None:
        """Readers see the document before or after, whole."""
        put_document(self.spark.createDataFrame([(json.dumps(payload, default=str),)], "value string"), f"{self.root}/{name}", "text")

    def read_document(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/{name}").first().value)

    def save_checkpoint(self, window: int, blob: dict, keep: int = 0) -> None:
        """Nested dicts of numbers, lists and arrays of any shape, as a table; the newest `keep` stay (all, if 0)."""
        rows = []
        for name, v in _flat(blob).items():
            x = np.asarray(v)
            kind = "array" if isinstance(v, np.ndarray) else "list" if isinstance(v, (list, tuple)) else "number"
            rows.append((window, name, kind, x.dtype.str, list(x.shape), x.astype(np.float64).ravel().tolist()))
        d = self.spark.createDataFrame(rows, "window long, name string, kind string, dtype string, shape array<long>, value array<double>")
        path = f"{self.root}/checkpoints"
        d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("window").parquet(path)
        if keep:
            have = sorted(r.window for r in self.spark.read.parquet(path).select("window").distinct().collect())
            jvm = self.spark.sparkContext._jvm
            for old in have[:-keep]:
                p = jvm.org.apache.hadoop.fs.Path(f"{path}/window={old}")
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def load_checkpoint(self, window: int | None = None) -> tuple | None:
        """(window, nested arrays) of the newest or the given checkpoint; None if there is none."""
        try:
            d = self.spark.read.parquet(f"{self.root}/checkpoints")
        except AnalysisException:
            return None
        window = d.agg(F.max("window")).first()[0] if window is None else window
        rows = d.where(F.col("window") == window).collect()
        return (window, _nested({r.name: _restored(r) for r in rows})) if rows else None


def _flat(blob: dict, prefix: str = "") -> dict:
    out = {}
    for k, v in blob.items():
        if isinstance(v, dict):
            out |= _flat(v, f"{prefix}{k}/")
        else:
            out[prefix + k] = v
    return out


def _restored(r):
    """A checkpoint's row as what was saved."""
    x = np.array(r.value, np.float64).astype(r.dtype).reshape(r["shape"])
    return x if r.kind == "array" else x.tolist()


def _nested(flat: dict) -> dict:
    out: dict = {}
    for name, value in flat.items():
        *path, last = name.split("/")
        at = out
        for p in path:
            at = at.setdefault(p, {})
        at[last] = value
    return out


def append_table(rows: DataFrame, table: str) -> None:
    """Append to a warehouse table, made if absent; columns that it lacks are left out, those that rows lack are null."""
    spark = rows.sparkSession
    if spark.catalog.tableExists(table):
        rows = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in spark.table(table).schema])
    rows.write.mode("append").saveAsTable(table)


def create_tables(spark: SparkSession, tape: str, metrics: str) -> None:
    """The warehouse's tables, where absent."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {tape} ({TAPE.replace(' ts long', ' ts timestamp')}) USING parquet")
    kept = ", ".join(f"{c} {'long' if c == 'window' else 'string' if c in ('run_id', 'utc') else 'double'}" for c in ("run_id", *WAREHOUSE_METRICS))
    spark.sql(f"CREATE TABLE IF NOT EXISTS {metrics} ({kept}) USING parquet")


def append_tape(rows: DataFrame, table: str, run_id: str, newest: int | None = None) -> None:
    """The newest windows of a tape (all, if none) to its warehouse table: epoch seconds become timestamps, NaN null."""
    if newest is not None:
        ids = rows.select("window_id").distinct()
        top = ids.withColumn("k", F.row_number().over(Window.orderBy(F.desc("window_id")))).where(F.col("k") <= newest).drop("k")
        rows = rows.join(top, "window_id", "left_semi")
    floats = [f.name for f in rows.schema if f.dataType.simpleString() in ("double", "float")]
    rows = rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})
    append_table(rows.withColumn("ts", F.timestamp_seconds("ts")).withColumn("run_id", F.lit(run_id)), table)


def append_metrics_table(rows: DataFrame, table: str, run_id: str) -> None:
    """The warehouse's share of the metric columns; blank or unreadable values become null."""
    kept = [F.expr(f"try_cast(nullif(trim(cast(`{c}` as string)), '') as {'long' if c == 'window' else 'string' if c == 'utc' else 'double'})").alias(c) for c in WAREHOUSE_METRICS if c in rows.columns]
    append_table(rows.select(F.lit(run_id).alias("run_id"), *kept), table)
