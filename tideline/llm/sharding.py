"""Sharding by sampled splitters.

Rows are keyed by (digest of the text, id, place in the table), so equal texts lie together and every key is unique.
Keys are drawn with odds in proportion to their rows' bytes; weighted quantiles of the sample are splitters, which part the
rows into many small ranges. A range that turns out overfull is sampled again, at its own rate, and
subdivided. Exact sums over ranges then give every row its place in the whole order, and shard
borders fall at equal bytes. Equal texts stay in one shard unless they exceed 1/WHOLE of a shard.

Scale: texts are read once, for size and digests; only these move. There are at most MOST_RANGES first ranges, so the sample, the
splitters and the sums of ranges that reach the driver are bounded whatever the data; a group of copies with a third of
all rows has a third of the splitters, even of rows that are equal in all. Running sums are taken inside ranges, never
over all rows in one task."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import NULL_ID, durable, release
from .shared import placed as with_places

RANGES_A_SHARD, SAMPLES_A_RANGE, RANGE_ROWS, MOST_RANGES, WHOLE = 16, 24, 500_000, 4096, 50
_LEAST = -(1 << 63)


def _table(spark, rows, schema):
    """A few rows as a table, by SQL functions alone."""
    one = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(0, 1, 1, 1).select(F.explode(one).alias("r")).select("r.*")


def _quantiles(sample, bound):
    """Keys at which the sample's weight passes multiples of bound."""
    out, run = [], 0.0
    for key, weight in sorted(sample):
        run += weight
        if run >= bound:
            out.append(key)
            run = 0.0
    return out


def _ranged(rows, splitters):
    """Adds `range`, how many splitters are not above the row's key. Splitters hang in a table of
    4096 prefixes, which is what its size is bounded by, beside the splitters."""
    spark = rows.sparkSession
    own = {}
    for h, i, p in splitters:
        own.setdefault(h[:3], []).append({"h": h, "i": i, "p": p})
    told, n = [], 0
    for p in (f"{x:03x}" for x in range(4096)):
        told.append({"start": p, "n": n, "own": own.get(p, [])})
        n += len(own.get(p, []))
    table = F.broadcast(_table(spark, told, "start: string, n: int, own: array<struct<h: string, i: bigint, p: bigint>>"))
    joined = rows.join(table, F.substring(rows.h, 1, 3) == table.start)
    below = F.size(F.filter("own", lambda s: s <= F.struct("h", "i", "p")))
    return joined.withColumn("range", F.col("n") + F.when(F.size("own") > 0, below).otherwise(0)).drop("start", "n", "own")


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, size (UTF-8 bytes and 8), text_crc32, shard, slot.

    Defined cases: null text counts as empty; a null id orders after all others; equal rows get
    neighbouring slots, in the order of their places; a row or small group whose middle lies on a border goes to the later
    shard; a text of any length is one row, so a shard may be as much longer; an empty table gives an empty one; other
    columns are ignored. The result doesn't depend on the sample, which only spreads the work."""
    spark = docs.sparkSession
    docs, place = with_places(docs)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = durable(
        docs.select(
            F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("i"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.md5(text).alias("h"),
            place.alias("p"),
        )
    )
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = min(MOST_RANGES, max(RANGES_A_SHARD * shards, count // RANGE_ROWS))
    bound = max(1.0, total / ranges)
    odds = F.pmod(F.xxhash64("h", "i", "p", F.lit("draw")), F.lit(1 << 40)) / float(1 << 40)

    def draw(part, bytes_in_it, n):
        """About n keys of part, each with the bytes that it stands for."""
        each = max(1.0, bytes_in_it / max(1, n))
        picked = part.where(odds * each < F.col("size")).select("h", "i", "p", F.greatest(F.col("size").cast("double"), F.lit(each)).alias("w"))
        return [((r.h, r.i, r.p), r.w) for r in picked.collect()]

    splitters = _quantiles(draw(rows, total, ranges * SAMPLES_A_RANGE), bound)
    whole = total / shards / WHOLE
    for _ in range(3):
        # small groups of equal texts are not parted: their splitter moves to their first key
        if splitters:
            asked = F.broadcast(_table(spark, [{"g": h} for h in sorted({h for h, _, _ in splitters})], "g: string"))
            big = {r.g for r in rows.join(asked, rows.h == F.col("g")).groupBy("g").agg(F.sum("size").alias("s")).where(F.col("s") > whole).collect()}
            splitters = sorted({(h, i, p) if h in big else (h, _LEAST, _LEAST) for h, i, p in splitters})
        placed = _ranged(rows, splitters)
        sums = {r["range"]: r.s for r in placed.groupBy("range").agg(F.sum("size").alias("s")).collect()}
        over = {k: s for k, s in sums.items() if s > 4 * bound}
        if not over:
            break
        mine = placed.where(F.col("range").isin(list(over)))
        more = _quantiles(draw(mine, sum(over.values()), len(over) * SAMPLES_A_RANGE * 4), bound)
        if set(more) <= set(splitters):
            break
        splitters = sorted(set(splitters) | set(more))
    placed = _ranged(rows, splitters)
    sums = placed.groupBy("range").agg(F.sum("size").alias("s"), F.count("*").alias("c"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    sums = sums.select("range", F.coalesce(F.sum("s").over(before), zero).alias("s0"), F.coalesce(F.sum("c").over(before), zero).alias("c0"))
    inside = Window.partitionBy("range").orderBy("h", "i", "p")
    group = Window.partitionBy("range", "h")
    runs = placed.join(sums, "range").withColumn("row", F.col("c0") + F.row_number().over(inside) - 1)
    runs = runs.withColumn("start", F.col("s0") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    runs = runs.withColumn("g", F.sum("size").over(group)).withColumn("g0", F.min("start").over(group))
    middle = F.when(F.col("g") <= whole, F.col("g0") + F.col("g") / 2).otherwise(F.col("start") + F.col("size") / 2)
    shard = F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(float(max(total, 1))))).cast("int")
    runs = durable(runs.select("i", "size", "text_crc32", "row", shard.alias("shard")))
    release(rows)
    firsts = F.broadcast(runs.groupBy("shard").agg(F.min("row").alias("first")))  # a row for each shard
    return runs.join(firsts, "shard").select(
        F.when(F.col("i") != NULL_ID, F.col("i")).alias("doc_id"), "size", "text_crc32", "shard", (F.col("row") - F.col("first")).cast("long").alias("slot")
    )
