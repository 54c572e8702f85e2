"""The pipeline's stages, each on its own input, against plain Python."""

import collections

import corpus_pipeline as p
import pytest
from brute import brute_components, brute_mix, key_of, leaks_of
from pyspark.sql import functions as F

from tideline.llm.language_id import identify_languages, train_language_id
from tideline.llm.sharding import shard_by_bytes


@pytest.fixture(scope="module")
def docs(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumn("row", F.lit(1)).withColumn("shard", F.lit("x")).withColumn("key", F.lit(2.5))
    prose = docs.where("doc_id = 3").first()
    other = docs.where("doc_id = 5").first()
    extra = [(9001, None, None, None, None), (9002, "", "en", "src1", 0), (None, other.text, other.lang, "src0", 1), (None, other.text + " and", other.lang, None, 1)]
    extra += [(None, prose.text, prose.lang, prose.source, k) for k in range(30)]
    extra = docs.sparkSession.createDataFrame([(*x, 1, "x", 2.5) for x in extra], docs.schema)
    return docs.unionByName(extra).unionByName(docs.where("doc_id = 3"))


@pytest.fixture(scope="module")
def seen(spark, data, docs):
    out = {}
    for name, stage in p.STAGES:
        before, docs = docs, stage(spark, docs, data)
        docs = p.durable(docs) if name != "sharding" else docs.cache()
        out[name] = (before, docs)
        if name != "sharding":
            assert docs.columns == before.columns
    return out


def test_identify(seen):
    before, after = seen["language ID"]
    accepted = identify_languages(before, train_language_id(before)).where("accepted").count()
    assert after.count() == accepted >= 0.95 * before.count() - 2 and after.where("text is null").count() == 0


def test_deduplicate(seen):
    before, after = (x.collect() for x in seen["MinHash near-dedup"])
    groups = collections.defaultdict(list)
    for r, (n, c) in zip(before, brute_components([r.text for r in before])):
        groups[c].append(r)
    want = collections.Counter()
    for c, rows in groups.items():
        if not rows[0].text.split():
            want.update((r.doc_id, r.text) for r in rows)
        else:
            best = min(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, key_of(r.doc_id, r.text)))
            want[best.doc_id, best.text] += 1
    assert collections.Counter((r.doc_id, r.text) for r in after) == want


def test_without_benchmark(spark, seen, data):
    before, after = (x.collect() for x in seen["benchmark decontamination"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    gone = {k for k, _, _ in leaks_of([(k, r.text) for k, r in enumerate(before)], items)}
    count = lambda rows: collections.Counter((r.doc_id, r.text) for r in rows)
    assert gone and count(after) == count(r for k, r in enumerate(before) if k not in gone)


def mixed(spark, docs, data):
    got = collections.Counter(key_of(r.doc_id, r.text, r.source) for r in p.mix(spark, docs, data).collect())
    want = brute_mix([(r.doc_id, r.text, r.source) for r in docs.collect()])
    assert got == +want


def test_mix(spark, seen, data, docs):
    mixed(spark, seen["mixing sources to target weights"][0], data)
    some = docs.where("doc_id < 9")
    for _ in range(6):
        some = some.unionByName(docs.where("doc_id < 9"))
    mixed(spark, some, data)
    # equal rows share the copies as evenly as can be
    one = docs.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")).withColumn("source", F.lit(None).cast("string"))
    many = p.durable(some.unionByName(one.crossJoin(F.broadcast(spark.range(25))).drop("id")).withColumn("row", F.monotonically_increasing_id()))
    mixed(spark, many, data)
    each = p.mix(spark, many, data).groupBy("doc_id", "text", "source", "row").count().groupBy("doc_id", "text", "source").agg(F.max("count").alias("hi"), F.min("count").alias("lo"))
    assert each.where("hi > lo + 1").count() == 0


def test_shard(seen):
    before, after = seen["sharding"]
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.select("doc_id", "size", "shard", "slot").collect())
    assert rows(after) == rows(shard_by_bytes(before, shards=24)) and after.count() == before.count()


def test_run_is_its_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in p.STAGES:
        docs = stage(spark, docs, data)
    rows = lambda df: sorted((r.doc_id, r.size, r.shard) for r in df.collect())
    assert rows(p.run(spark, data)) == rows(docs)


def test_empty(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, data)
    assert docs.count() == 0
