"""What each filter removes, in every order of the filters, by direct relational replay.

Every document's flags meet all orders of the filters (120 rows of five filters, broadcast), the first failure in
each order is computed, the steps are exploded, and conditional sums count what happens at each step.

Scale: whole texts are read once, for flags and a digest; repeats are found by a join on digests in which Spark can split
a hot digest, and whose other side has one row for each repeated digest. The replay makes rows inside a task only: sums are combined
there, so a task sends at most (parts x orders x steps) rows, however many documents it has."""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import NULL_ID, durable

#: Orders grow as the factorial of the filters; their table is broadcast, so filters are bounded.
MOST_FILTERS = 6
_CAPITAL, _SYMBOL = np.zeros(256, bool), np.zeros(256, bool)
_STARTS = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a character
_CAPITAL[65:91] = True
_SYMBOL[list(b"#$%&*|")] = True


def _flags(batches):
    """Arrow mapper: (id, part, text) to id, part, the flags A to D and the text's digest."""
    for batch in batches:
        for lo, body, offsets in tk.slabs(batch.column(2)):
            words = tk.Words(body, offsets)
            n, row, h = np.diff(words.first), words.rows(), words.hashes()
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            distinct = np.bincount(row[new], minlength=len(n))

            def count(mark, at=offsets, body=body):
                total = np.r_[0, np.cumsum(mark[body])]
                return total[at[1:]] - total[at[:-1]]

            points = count(_STARTS)
            raw = body.tobytes()
            digests = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            marks = [n < 100, 100 * distinct < 80 * n, 100 * count(_CAPITAL) > 10 * points, count(_SYMBOL) > 0]
            part = batch.slice(lo, len(n))
            columns = [part.column(0), part.column(1), *[pa.array(m) for m in marks], pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", *"ABCD", "digest"])


def document_flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each row of docs: doc_id, part, and booleans A to E, true where the document fails.

    A: under 100 words; B: under 80 percent of the words are distinct; C: over 10 percent of the characters are
    A-Z; D: holds one of #$%&*|; E: the text is that of a smaller id. Words are told apart by 64 bits inside a text,
    texts by their SHA-256. Defined cases: null text is empty, and all such
    texts are equal; null part is the empty string; a null id is larger than every other; rows with one id are
    not repeats of each other, equal or not; a text of any length is read whole, in one task at about 40 times its bytes; an
    empty table gives an empty one; other columns are ignored."""
    one = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        F.col(f"`{text_col}`").alias("text"),
    )
    told = durable(one.mapInArrow(_flags, "doc_id long, part string, A boolean, B boolean, C boolean, D boolean, digest binary"))
    place = F.coalesce("doc_id", F.lit(NULL_ID))
    repeated = told.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    # written, so that both sides of the join are plain shuffles, of which Spark can split a hot digest's
    first = durable(repeated.select("digest", "first"))
    later = F.coalesce(place > F.col("first"), F.lit(False))
    return told.join(first, "digest", "left").select("doc_id", "part", "A", "B", "C", "D", later.alias("E"))


def replay_orders(flags: DataFrame, filters: tuple, outcomes: dict[str, str] | None = None, part: str = "part") -> DataFrame:
    """flags: rows with a boolean column for each filter (true: fails; null: passes) and for each outcome.

    One row, zeros included, for each part that occurs, order of all filters and step: part, filter_order (the filters' names
    joined), step (from 1), kept, removed, redundant, unique_fails, shapley, and for each item (name: column)
    of outcomes, how many of the rows removed here have it. An empty table gives an empty one."""
    if not 0 < len(filters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters are replayed in all orders, not {len(filters)}")
    outcomes = outcomes or {}
    steps = range(len(filters))
    orders = flags.sparkSession.createDataFrame(
        [(at, "".join(filters[k] for k in p), [1 << k for k in p]) for at, p in enumerate(permutations(steps))],
        "number int, filter_order string, bits array<int>",
    )
    fails = sum((F.when(F.col(f), F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(filters)), F.lit(0))
    rows = flags.select(F.col(part).alias("part"), fails.alias("fails"), *[F.coalesce(F.col(c), F.lit(False)).alias(name) for name, c in outcomes.items()])
    met = rows.crossJoin(F.broadcast(orders.drop("filter_order")))
    first: Column = F.lit(len(filters))
    for k in reversed(steps):
        first = F.when(F.col("fails").bitwiseAND(F.col("bits")[k]) != 0, F.lit(k)).otherwise(first)
    each = met.withColumn("first", first).select("part", "number", "fails", "first", *outcomes, F.posexplode("bits").alias("at", "bit"))
    here, failing = F.col("first") == F.col("at"), F.col("fails").bitwiseAND(F.col("bit")) != 0
    count = lambda c: F.count(F.when(c, 1))
    sums = each.groupBy("part", "number", "at").agg(
        count(F.col("first") > F.col("at")).alias("kept"),
        count(here).alias("removed"),
        count(failing & (F.col("first") < F.col("at"))).alias("redundant"),
        count(F.col("fails") == F.col("bit")).alias("unique_fails"),
        *[count(here & F.col(name)).alias(name) for name in outcomes],
    )
    named = sums.join(F.broadcast(orders), "number").withColumn("bit", F.col("bits")[F.col("at")])
    # a part has as many rows here as there are orders and steps
    shapley = F.sum("removed").over(Window.partitionBy("part", "bit"))
    told = named.withColumn("shapley", shapley).withColumn("step", F.col("at") + 1)
    return told.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *outcomes, "shapley")


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The five filters of document_flags in all 120 orders: rows as of replay_orders, with good_lost (removed
    here, a label with quality 1) and toxic_lost (a label with toxic 1).

    labels: doc_id, quality, toxic. A document with several labels counts as good or toxic if any says so; labels
    of null or unknown ids, and null labels, count for nothing. Rows with one id share its labels."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    said = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    told = known.agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    flags = document_flags(docs, id_col, text_col, part_col).join(told, "doc_id", "left")
    return replay_orders(flags, tuple("ABCDE"), {"good_lost": "good", "toxic_lost": "toxic"})
