"""Mixing sources to target weights by weighted fair queueing.

Documents are shuffled by a hash of their id. Within its source each gets a virtual finish time: the
source's words up to and with it, divided by the source's target. A target may exceed the source's size;
then the source is queued again, so a document has one finish time for each of its passes. All
are sorted by finish time and the queue is cut at the total budget.

Scale: equal rows travel as one record with a count until they have their places, so copies of a row by the
million meet in no task. Both running sums have two levels. Sums over hash slices of each source (and over
slices of the finish time) are pre-aggregated and added up; inside a slice a window runs. The number of
slices follows the rows, SLICE_ROWS to a slice on average, so a source with a third of all rows spreads over a third
of the slices, and only the slice that the budget cuts is ordered in full."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import NULL_ID, WORD_PATTERN, durable, release, row_key

SLICE_ROWS, LEAST_DIGITS, CHUNK = 50_000, 3, 1000


def source_targets(sizes: DataFrame, weights: tuple, share: float, most: float) -> DataFrame:
    """sizes: source, source_size. Adds place (sources by code point, null last) and target.

    Weights go to sources in turn. The budget, share times all sizes, is split by weight; no
    target exceeds most times its source's size, and what that leaves over is split again by weight.
    That ends at min(cap, level * weight) for one level, found from prefix sums over cap / weight."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "place")
    every = Window.partitionBy()
    t = sizes.withColumn("place", F.row_number().over(by_name) - 1)
    t = t.withColumn("weight", w[F.col("place") % len(weights)]).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    t = t.withColumn("ratio", F.col("cap") / F.col("weight"))
    done = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(every))
    t = t.withColumn("level", (F.col("budget") - done) / rest)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(every)["level"]
    t = t.withColumn("target", F.coalesce(F.least("cap", level * F.col("weight")), F.col("cap")))
    return t.select("source", "source_size", "place", "target", "budget")


def mix_sources(
    docs: DataFrame,
    weights: tuple = (3, 1, 2),
    share: float = 1.5,
    passes: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row for each row of docs: doc_id, source, size (words), source_size, target, taken
    (words that the mix takes, repeats counted), row_key (row_key of id, text and source).

    Defined cases: null text has size 0 and is taken 0 times; a null source is a source, the last
    one; a null id is shuffled by the row's key; rows that share an id are told apart by their
    texts; equal rows stand together in the queue, so they fare alike unless the budget ends among them;
    equal finish times are ordered by source, pass, shuffle, id, size and key; texts of any length are counted in their row; an
    empty table gives an empty one; other columns are ignored. Reruns agree, for the shuffle is a hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    one = docs.select(
        F.col(id_col).alias("i"),
        F.col(source_col).alias("source"),
        F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("size"),
        row_key(id_col, text_col, source_col).alias("g"),
    ).withColumn("h", F.md5(F.coalesce(F.col("i").cast("string").cast("binary"), "g")))
    rows = durable(one.groupBy("source", "h", "i", "size", "g").agg(F.count("*").alias("copies")))
    digits = max(LEAST_DIGITS, math.ceil(math.log(max(1, rows.count() / SLICE_ROWS), 16)))
    slices_of_time = 16**digits
    rows = rows.withColumn("slice", F.conv(F.substring("h", 1, digits), 16, 10).cast("long"))
    words = F.col("size") * F.col("copies")
    slices = rows.groupBy("source", "slice").agg(F.sum(words).alias("s"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = slices.withColumn("before", F.coalesce(F.sum("s").over(before), F.lit(0)))
    targets = source_targets(slices.groupBy("source").agg(F.sum("s").alias("source_size")), weights, share, passes)
    t = durable(targets)
    told = sums.alias("a").join(t.alias("b"), F.expr("a.source <=> b.source")).select("a.slice", "a.before", "b.*")
    order = [F.col("r.h"), F.coalesce(F.col("r.i").cast("long"), F.lit(NULL_ID)), F.col("r.size"), F.col("r.g")]
    inside = Window.partitionBy("r.source", "r.slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.alias("r").join(told.alias("t"), F.expr("r.source <=> t.source AND r.slice = t.slice"))
    placed = placed.select(
        "r.i", "r.source", "r.size", "r.g", "r.h", "r.copies", "t.source_size", "t.place", "t.target", "t.budget",
        (F.col("t.before") + F.sum(F.col("r.size") * F.col("r.copies")).over(inside) - F.col("r.size") * F.col("r.copies")).alias("from"),
    )
    placed = durable(placed)
    # a row for each copy; many copies of one row are dealt out in chunks first
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {CHUNK}")))
    many = placed.where("copies > 1").withColumn("chunk", chunks).repartition("g", "chunk")
    in_chunk = F.sequence(F.col("chunk") * CHUNK, F.least(F.col("copies"), (F.col("chunk") + 1) * CHUNK) - 1)
    many = many.withColumn("copy", F.explode(in_chunk)).drop("chunk")
    placed_all = placed.where("copies = 1").withColumn("copy", F.lit(0).cast("long")).unionByName(many)
    placed_all = placed_all.withColumn("upto", F.col("from") + (F.col("copy") + 1) * F.col("size")).drop("from", "copies")
    done = placed
    placed = durable(placed_all)
    release(done, rows)

    def finish(k):
        return F.when(F.col("target") > 0, (F.lit(k) * F.col("source_size") + F.col("upto")) / F.col("target")).otherwise(F.lit(2.0))

    def ticket(k):
        return F.struct(
            finish(k).alias("finish"), F.col("place").alias("place"), F.lit(k).alias("pass"), F.col("h").alias("h"),
            F.coalesce(F.col("i").cast("long"), F.lit(NULL_ID)).alias("i"), F.col("size").alias("size"), F.col("g").alias("g"), F.col("copy").alias("copy"),
        )

    # a slice of the finish time; the budget's end lies near 1
    at = lambda k: F.least(F.floor(ticket(k)["finish"] * slices_of_time), F.lit(2 * slices_of_time))
    queue = placed.where("size > 0").select("size", "budget", F.explode(F.array(*[F.struct(at(k).alias("at"), ticket(k).alias("k")) for k in range(passes)])).alias("q"))
    sums = queue.groupBy("q.at").agg(F.sum("size").alias("s"), F.max("budget").alias("budget"))
    upto = F.sum("s").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    edge = sums.withColumn("upto", upto).where(F.col("upto") > F.col("budget")).orderBy("at").first()
    if edge is None:  # the budget holds all passes
        taken = F.col("size") * passes
    else:
        left = edge.budget - (edge.upto - edge.s)
        run = F.sum("size").over(Window.orderBy("q.k").rowsBetween(Window.unboundedPreceding, 0))
        cut = queue.where(F.col("q.at") == edge["at"]).select(F.col("q.k").alias("k"), run.alias("run"))
        last = cut.where(F.col("run") <= left).agg(F.max("k").alias("k")).first().k

        def takes(k):
            if last is None:
                return at(k) < edge["at"]
            end = F.struct(F.lit(last.finish), F.lit(last.place), F.lit(last["pass"]), F.lit(last.h), F.lit(last.i).cast("long"), F.lit(last["size"]).cast("long"), F.lit(bytes(last.g)), F.lit(last["copy"]).cast("long"))
            return (at(k) < edge["at"]) | ((at(k) == edge["at"]) & (ticket(k) <= end))

        taken = sum((F.when(takes(k), F.col("size")).otherwise(F.lit(0)) for k in range(passes)), F.lit(0))
    release(t)
    return placed.select(F.col("i").alias("doc_id"), "source", "size", "source_size", "target", taken.cast("long").alias("taken"), F.col("g").alias("row_key"))
