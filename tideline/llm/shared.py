"""Helpers that the corpus operators share: durable intermediate tables, row keys, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that part words: space and the ASCII controls 9 to 13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Stands for a null identifier inside the operators; it orders after every other one.
NULL_ID = (1 << 63) - 1
_written: dict = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share: spark.checkpoint.dir. Where that is unset and all
    run on one machine (tests) it is a temporary folder; on a cluster that is an error, for each
    executor would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tideline-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _delete(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _sweep():
    """At the interpreter's end, tables that still back results go too."""
    for path, spark in list(_written.items()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


def scratch(spark: SparkSession) -> str:
    """A path for a table in the shared folder, which goes at the interpreter's end."""
    if not _written:
        atexit.register(_sweep)
    path = f"{shared_dir(spark)}/tideline-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def durable(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, and survives the
    loss of executors. Unlike cache() nothing depends on executor memory or local disks."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tideline_path = path
    return out


def release(*tables: DataFrame):
    """Deletes durable tables that nothing will read any more."""
    for t in tables:
        path = getattr(t, "tideline_path", None)
        if path in _written:
            _delete(_written.pop(path), path)


def let(value, body):
    """body(value), with value computed once: an expression used inside a lambda, or by two others,
    would be computed again each time."""
    return F.transform(F.array(value), body)[0]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(*columns: str) -> Column:
    """128 bits that tell rows with other values in these columns apart; null differs from every value."""
    parts = [F.when(F.col(f"`{c}`").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(":"), F.col(f"`{c}`").cast("string"))) for c in columns]
    return F.unhex(F.md5(F.concat(*parts).cast("binary")))


def as_read(docs: DataFrame) -> DataFrame:
    """docs, if each of its rows is one row of a file, by a plan of one scan, filters and projections; else (joins,
    explode, union, sample, rows of the session) docs as written and read back."""
    node = docs._jdf.queryExecution().analyzed()
    same = node.deterministic()
    while same and node.children().size() == 1 and node.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    if same and node.getClass().getSimpleName() == "LogicalRelation":
        try:
            docs.select("_metadata.row_index")
            return docs
        except AnalysisException:  # not a kind of file that numbers its rows
            pass
    return durable(docs)


def placed(docs: DataFrame) -> tuple:
    """docs and a 64-bit column that is another for every row, equal ones too, and the same whenever docs is
    read: the row's place in its file."""
    docs = as_read(docs.drop("_metadata"))  # a column of this name would hide the place
    return docs, F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (u, v): rows (u, root), root the smallest node.

    Alternating large-star and small-star contraction, all in joins and partial aggregates. Nodes
    that no edge names are absent. Each round is a written table, so lineage stays short; rounds
    end when the edge set no longer changes."""
    e = durable(
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        after = durable(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        release(e)
        e = after
        seen = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(seen) == before:
            out = e.select("u", F.col("v").alias("root"))
            out.tideline_path = e.tideline_path
            return out
        before = tuple(seen)
