"""From raw documents to sharded training data: five stages, each a table that the next one reads.

Cases, alike in all stages: documents may have further columns of any name, which pass through (but for the last stage,
which returns places); rows are told apart by 128-bit keys of id and text (and source, where mixed), so null and repeated
ids pass; empty tables give empty ones; texts of any length are read whole. By stage: null texts and those without a letter have no
language and go; of equal rows, as of any group of near-duplicates, one stays, that with the smallest id, then
key, while texts without words are in no group and all stay; a document goes if it leaks any item, ties or not; in the mix equal rows
get as many copies as their places in the queue give them together, dealt out evenly; shards are cut at equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.decontamination import decontaminate
from tideline.llm.language_id import keep_identified, train_language_id
from tideline.llm.minhash import near_duplicates
from tideline.llm.mixing import mix_sources
from tideline.llm.sharding import shard_by_bytes
from tideline.llm.shared import as_read, durable, release, row_key

CHUNK_ROWS = 10_000


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """The rows, whole, under a name that clashes with none, and their keys."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key(*columns).alias("key"))


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID; documents that it rejects go."""
    return keep_identified(docs, train_language_id(docs))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup; one document of each group stays."""
    found = near_duplicates(docs).where("kept")
    group = F.coalesce(F.col("component_key").cast("string").cast("binary"), F.col("row_key"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("m")
    grouped = found.groupBy(group.alias("group"), F.col("component_key").isNull().alias("alone")).agg(first, F.count("*").alias("n"))
    # texts without words are in no group: all their rows stay
    kept = durable(grouped.select(F.col("m.row_key").alias("key"), "alone"))
    rows = _keyed(docs, "doc_id", "text")
    one = rows.join(kept.where("not alone"), "key", "left_semi").groupBy("key").agg(F.any_value("row").alias("row")).select("row.*")
    return one.unionByName(rows.join(kept.where("alone"), "key", "left_semi").select("row.*"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination; documents with a leak go."""
    leaks = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _keyed(docs, "doc_id", "text").join(leaks.select(F.col("row_key").alias("key")).distinct(), "key", "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights; a document that is taken twice is there twice."""
    taken = mix_sources(docs).where("size > 0").groupBy(F.col("row_key").alias("key"))
    times = taken.agg(F.count("*").alias("rows"), F.sum(F.expr("taken div size")).alias("times")).where("times > 0")
    times = durable(times.select("key", F.expr("times div rows").alias("each"), (F.col("times") % F.col("rows")).alias("more")))
    docs = as_read(docs.drop("_metadata"))
    columns = ("doc_id", "text", "source")
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias("place")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key(*columns).alias("key"), place)
    # where the budget ends among equal rows, the first of them by place get one more: at most a key for each source and pass
    split = F.broadcast(times.where("more > 0").select("key", "more"))
    few = durable(docs.select(row_key(*columns).alias("key"), place).join(split, "key").select("key", "more", "place.*").withColumn("chunk", F.expr(f"at div {CHUNK_ROWS}")))
    chunks = few.groupBy("key", "file", "chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("file", "chunk").rowsBetween(Window.unboundedPreceding, -1))
    chunks = chunks.withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("key", "file", "chunk").orderBy("at"))
    ranked = few.withColumn("rank", rank).join(chunks, ["key", "file", "chunk"]).where("before + rank <= more")
    extra = durable(ranked.select(F.struct("file", "at").alias("place"), F.lit(1).alias("extra")))
    all_times = rows.join(times, "key").join(extra, "place", "left").select("row", (F.col("each") + F.coalesce("extra", F.lit(0))).cast("int").alias("times"))
    out = all_times.where("times > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("row.*")
    release(few)
    return out


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sharding by bytes: the place of every row."""
    return shard_by_bytes(docs, shards=24)


STAGES = [
    ("language ID", identify),
    ("MinHash near-dedup", deduplicate),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mix),
    ("sharding", shard),
]

#: Language ID learns by gradient descent, which SQL can't express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = durable(docs)
        if 0 < k < len(STAGES) - 1:
            release(before)
    return docs
