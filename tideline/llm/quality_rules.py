"""Quality rules with risk-controlled thresholds.

Each rule rejects a document whose statistic exceeds a cutoff. The rules tighten together, along one path of STEPS cutoffs from
extremes to the strictest that such rules usually have. How far, is chosen stratum by stratum from the labelled good
documents that pass the base rules: from lenient to strict, as long as an exact binomial upper bound on the share that any
rule rejects falsely stays within LIMIT. Testing in a fixed order needs no correction along the path; DELTA is
divided by the number of strata. So with probability 1 - DELTA no stratum loses more than LIMIT of its good documents;
a stratum with too few labels for that (about 150 and more, as strata grow) keeps all that pass the base rules.

Scale: statistics are one Arrow pass over whole texts; after it only a few numbers for each document move. Labels
are counted, not collected: a row for each stratum with enough labels for any certificate reaches the driver, and
rows meet their stratum's cutoffs in a map, which those strata alone make up."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import durable, release

LIMIT, DELTA, STEPS = 0.02, 0.05, 32
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _path(first, last, spread):
    return [round(float(x), 4) for x in spread(first, last, STEPS)]


#: Rules: a statistic of the columns, and its cutoffs along the path, from lenient to strict.
_WORDS = "greatest(n_words, 1)"
RULES = {
    "symbols": (f"n_symbols / {_WORDS}", _path(4, 0.1, np.geomspace)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", _path(0.96, 0.3, np.linspace)),
    "repeats": (f"n_repeat_words / {_WORDS}", _path(0.49, 0.2, np.linspace)),
    "long_words": (f"word_chars / {_WORDS}", _path(60, 10, np.geomspace)),
    "short_words": (f"-word_chars / {_WORDS}", _path(-1, -3, np.linspace)),
}


def _statistics(batches):
    """Arrow mapper: (text, ...) to the counts, other columns kept."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    for batch in batches:
        got = {c: np.zeros(batch.num_rows, np.int64) for c in names}
        for lo, body, offsets in tk.slabs(batch.column(0)):
            rows = slice(lo, lo + len(offsets) - 1)
            n = len(offsets) - 1
            w = tk.Words(body, offsets)
            total = lambda mask: np.diff(np.r_[0, np.cumsum(mask)][offsets])
            inside = ~tk._SEP[body]
            got["n_words"][rows] = np.diff(w.first)
            got["word_chars"][rows] = total(inside & ((body & 0xC0) != 0x80))
            got["n_symbols"][rows] = total(_SYMBOL[body])
            breaks = np.flatnonzero(body == 10)
            ends = np.sort(np.r_[breaks, offsets[1:]])
            owner = np.r_[np.searchsorted(offsets, breaks, "right") - 1, np.arange(n)]
            owner = owner[np.argsort(np.r_[breaks, offsets[1:]], kind="stable")]
            starts = np.maximum(np.r_[0, ends[:-1]] + np.r_[False, body[np.minimum(ends[:-1], len(body) - 1)] == 10] if len(body) else np.r_[0, ends[:-1]], offsets[owner])
            words = np.r_[0, np.cumsum(inside)]
            full = words[ends] > words[starts]
            starts, ends, owner = starts[full], ends[full], owner[full]
            got["n_lines"][rows] = np.bincount(owner, minlength=n)
            h = tk.mix(tk.span_hashes(tk._RANDOM[body], starts, ends, tk._P)) ^ tk.mix(owner.astype(np.uint64))
            _, first = np.unique(h, return_index=True)
            later = np.ones(len(h), bool)
            later[first] = False
            got["n_dup_lines"][rows] = np.bincount(owner[later], minlength=n)
            runs = tk.run_hashes(w.hashes(), 3)
            at = np.flatnonzero(tk.whole_runs(w.first, 3))
            row = np.searchsorted(w.first, at, "right") - 1
            _, to, c = np.unique(runs[at] ^ tk.mix(row.astype(np.uint64)), return_inverse=True, return_counts=True)
            at = at[c[to] > 1]
            hit = np.zeros(len(w.starts), bool)
            for j in range(3):
                hit[at + j] = True
            got["n_repeat_words"][rows] = np.diff(np.r_[0, np.cumsum(hit)][w.first])
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(v) for v in got.values()]], names=[*batch.schema.names[1:], *names])


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper and Pearson's upper bound: the share at which k or fewer of n have probability delta."""
    if k >= n:
        return 1.0
    terms = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) for j in range(k + 1)]

    def tail(p):
        logs = [t + j * math.log(p) + (n - j) * math.log1p(-p) for j, t in enumerate(terms)]
        top = max(logs)
        return top + math.log(sum(math.exp(x - top) for x in logs))

    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if mid >= 1 or tail(mid) < math.log(delta):
            hi = mid
        else:
            lo = mid
    return hi


def choose_cutoffs(over: list, n: int, part: float, delta: float) -> int:
    """How many steps of the path, lenient first, are certified; over: good documents that each rejects."""
    for place, k in enumerate(over):
        if k > n * part or upper_bound(k, n, delta) > part:
            return place
    return len(over)


def quality_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum and the counts of every row; null text has none of anything."""
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(text_col).alias("x"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"))
    counts = ", ".join(f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"))
    return slim.mapInArrow(_statistics, f"doc_id {kind}, stratum string, {counts}")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def apply_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    limit: float = LIMIT,
    delta: float = DELTA,
) -> DataFrame:
    """One row for each row of docs: doc_id, the counts, base_failed, kept, broken (rules, joined by a
    comma).

    labels has doc_id and quality (1: good); a document with several labels is good if all say so.
    Defined cases: null text has no words and fails the base rules; a null stratum is a stratum; null ids have
    no label; repeated rows stay, and count as often as they occur if labelled; a value equal to a cutoff doesn't exceed it;
    texts of any length are counted whole, at about 50 times their bytes in one task's memory; without labels the base
    rules alone decide; empty tables give an empty result; other columns are ignored."""
    stats = durable(quality_statistics(docs, id_col, text_col, stratum_col))
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select(F.col("doc_id").alias("good_id"))
    held = stats.where(~base_failed()).join(good, F.col("doc_id") == F.col("good_id"), "left_semi")

    def rejected(step):
        return reduce(lambda x, y: x | y, [F.expr(value) > cutoffs[step] for value, cutoffs in RULES.values()])

    counted = durable(held.groupBy("stratum").agg(F.count("*").alias("n"), F.array(*[F.count_if(rejected(k)) for k in range(STEPS)]).alias("over")))
    share = delta / max(1, counted.count())
    enough = math.log(share) / math.log1p(-limit)  # fewer labels certify nothing, not even without an error
    steps = {r.stratum: choose_cutoffs(list(r.over), r.n, limit, share) for r in counted.where(F.col("n") >= enough).collect()}
    steps = {stratum: k - 1 for stratum, k in steps.items() if k}
    release(counted)
    out = stats.withColumn("base_failed", base_failed())
    hits = F.array().cast("array<string>")
    if steps:
        at = F.create_map(*[F.lit(x) for pair in steps.items() for x in pair])[F.col("stratum")]
        cutoff = lambda values: F.get(F.array(*[F.lit(v) for v in values]), at)
        broken = [F.when(F.expr(value) > cutoff(cutoffs), F.lit(name)) for name, (value, cutoffs) in RULES.items()]
        hits = F.filter(F.array(*broken), lambda x: x.isNotNull())
    out = out.withColumn("broken", F.array_join(hits, ","))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("broken") == ""))
