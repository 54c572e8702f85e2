"""Benchmark decontamination by template canonicalisation.

Numbers, units behind numbers and names inside sentences become typed placeholders, so a question
with other numbers or names keeps its template; a name of several words is one placeholder. Windows of
template words of both sides are hash-joined; windows of one document and item at one offset make runs. A run counts if
its slots are consistent: each value of the item stands for one value in the document; where they aren't, its
verbatim stretches do. Runs at neighbouring offsets (a word put in or left out) add up. What covers enough words is a leak.
Names are known by their capitals, which texts all in lower or upper case don't have: every item with names therefore has a second form, whose
names are plain words. Documents have one form, so this costs them nothing.

Scale: DataFrame functions alone. A document's windows are hashed in its row; the benchmark's
windows are broadcast only if a count shows them to be at most BROADCAST_WINDOWS, else both sides are
shuffled by the hash. Only matches go on, and only matched documents' texts are read again for slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import NULL_ID, durable, let, release, row_key

WINDOW, LEAK_WORDS, SHORT_WORDS, NEAR_OFFSETS, BROADCAST_WINDOWS = 8, 13, 4, 16, 500_000
#: Words that are units when a number stands before them.
UNITS = (
    "%", "km", "m", "cm", "mm", "mi", "miles", "ft", "feet", "inches", "kg", "g", "mg", "lb", "lbs", "pounds", "tons", "l",
    "ml", "liters", "litres", "s", "sec", "seconds", "min", "minutes", "h", "hr", "hours", "days", "weeks", "months", "years",
    "kmh", "mph", "dollars", "euros", "cents", "usd", "eur", "degrees", "c", "f", "k", "w", "kw", "v", "hz", "mb", "gb", "tb",
)


def valued(text: Column) -> Column:
    """The text with slots written as #n=3_5, #u=km and #p=smith, lower-cased otherwise."""
    t = F.translate(text, "#=_", "   ")
    t = F.regexp_replace(t, r"\p{Lu}(?<=[^.!?:;\x22\s] .)(?=\p{Ll})[\p{L}\p{M}]*", "#p=$0")
    t = F.regexp_replace(t, r" #p=(?<=#p=[\p{L}\p{M}]{1,40} #p=)", "_")
    t = F.regexp_replace(F.lower(t), r"(?<=[0-9])[.,](?=[0-9])", "_")
    t = F.regexp_replace(t, r"([0-9][0-9_]*)[ \x2D]?(" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")(?![\p{L}\p{N}])", " #n=$1 #u=$2 ")
    t = F.regexp_replace(t, r"%", "pct")
    return F.regexp_replace(t, r"(?<![=0-9_\p{L}])([0-9][0-9_]*)(?![\p{L}0-9_])", " #n=$1 ")


def tokens(marked: Column) -> Column:
    return F.filter(F.split(marked, r"[^\p{L}\p{M}\p{N}#=_]+"), lambda w: w != "")


def template(marked: Column) -> Column:
    """Words of the template: slots without their values."""
    return tokens(F.regexp_replace(marked, r"=[\p{L}\p{M}\p{N}_]+", ""))


def window_hashes(words: Column, size: int) -> Column:
    """A hash for each window of `size` words; fewer words make one, which is no item's."""

    def run(w):
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1)))
        return F.when(F.size(w) > 0, F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, size))))

    return let(words, run)


def _positions(ats, size: int, words) -> Column:
    """Sorted places in the item that windows at `ats` cover."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(ats, lambda x: F.sequence(x, F.least(x + size, words) - 1)))))


def _stretches(places) -> Column:
    """Maximal runs of neighbouring places: structs of first and last."""

    def parts(p):
        first = F.filter(p, lambda x: ~F.array_contains(p, x - 1))
        last = F.filter(p, lambda x: ~F.array_contains(p, x + 1))
        return F.zip_with(first, last, lambda s, e: F.struct(s.alias("first"), e.alias("last")))

    return let(places, parts)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Leaks, a row for each document (id and text) and item: doc_id, item_id, matched_words (of the item, in the
    form of it that covers most), item_words (of that form), slots (in the matched words), verbatim (no slot has another value), row_key (row_key of id and text).

    A leak covers at least LEAK_WORDS words of the item, or all but one of a shorter item (its first word is
    taken for a name where it follows on a sentence). Items of fewer than WINDOW words leak only with the
    same values, inside a document if they have SHORT_WORDS words, else as the whole document. Windows with slots in over half
    of their words are evidence only for items that have no others, and only with the same values.
    Defined cases: null or wordless texts match nothing; equal rows give one result; a null id is reported
    as null; of several places with the same item the one that covers most counts, then the one with most equal
    values; a text of any length is matched whole, in its row; empty tables give an empty result; other columns are ignored."""
    i = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("i")
    rows = docs.where(F.col(text_col).isNotNull()).select(i, F.col(text_col).alias("x"), row_key(id_col, text_col).alias("g"))
    forms = F.posexplode(F.array_distinct(F.array(valued(F.col(item_text_col)), valued(F.lower(F.col(item_text_col))))))
    items = benchmark.where(F.col(item_text_col).isNotNull()).select(F.col(item_col).alias("id"), forms.alias("form", "y"))
    items = items.select(F.struct("id", "form").alias("item"), tokens(F.col("y")).alias("iv"), template(F.col("y")).alias("c"))
    items = durable(items.withColumn("n", F.size("c")).where("n > 0"))
    hashed = items.where(F.col("n") >= WINDOW).select("item", "n", "c", "iv", F.posexplode(window_hashes(F.col("c"), WINDOW)).alias("at", "w"))
    slots = F.size(F.filter(F.slice("c", F.col("at") + 1, WINDOW), lambda w: w.startswith("#")))
    hashed = hashed.withColumn("plain", slots * 2 <= WINDOW)
    some = hashed.groupBy("item").agg(F.max("plain").alias("some"))
    hashed = hashed.join(some, "item").where(F.col("plain") | ~F.col("some"))
    heavy = F.xxhash64(F.slice("iv", F.col("at") + 1, WINDOW))
    long_items = hashed.select("item", "n", "at", F.when(F.col("plain"), F.col("w")).otherwise(heavy).alias("w"), F.when(F.col("plain"), F.lit(WINDOW)).otherwise(-WINDOW).alias("size"))
    # of short items one window, their whole; those under SHORT_WORDS only meet documents as short
    short = items.where(F.col("n") < WINDOW).select("item", "n", F.lit(0).alias("at"), F.xxhash64("iv").alias("w"), F.when(F.col("n") < SHORT_WORDS, F.lit(0)).otherwise(-F.col("n")).alias("size"))
    probes = durable(long_items.unionByName(short))
    sizes = sorted(r["size"] for r in probes.select("size").distinct().collect())  # at most ten kinds
    small = probes.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    # size > 0: windows of the template; < 0: of words with their values; 0: the whole text, if short
    kinds = []
    for size in sizes:
        if size > 0:
            found = window_hashes(F.col("c"), size)
        elif size < 0:
            found = F.when(F.size("v") >= -size, window_hashes(F.col("v"), -size))
        else:
            found = F.when(F.size("v") < SHORT_WORDS, F.array(F.xxhash64("v")))
        kinds.append((size, found))
    marked = rows.select("i", "g", valued(F.col("x")).alias("y"))
    plain_only = all(size > 0 for size in sizes)
    if plain_only:
        each = marked.select("i", "g", F.posexplode(window_hashes(template(F.col("y")), WINDOW)).alias("pos", "w"), F.lit(WINDOW).alias("size"))
    else:
        told = marked.select("i", "g", let(F.col("y"), lambda y: F.struct(template(y).alias("c"), tokens(y).alias("v"))).alias("r")).select("i", "g", "r.c", "r.v")
        each = None
        for size, found in kinds:
            one = told.select("i", "g", F.posexplode(found).alias("pos", "w"), F.lit(size).alias("size"))
            each = one if each is None else each.unionByName(one)
        if each is None:
            each = told.select("i", "g", F.lit(0).alias("pos"), F.lit(0).cast("long").alias("w"), F.lit(0).alias("size")).limit(0)
    met = each.join(F.broadcast(probes) if small else probes, ["w", "size"])
    aligned = met.groupBy("i", "g", "item", "n", "size", (F.col("pos") - F.col("at")).alias("shift")).agg(F.collect_set("at").alias("ats"))
    wide = F.when(F.col("size") == 0, F.col("n")).otherwise(F.abs("size"))
    aligned = aligned.withColumn("p", _positions(F.col("ats"), wide, F.col("n")))
    # neighbouring offsets share a group of NEAR_OFFSETS in one of two gridings
    half = NEAR_OFFSETS // 2
    group = F.explode(F.array(F.floor(F.col("shift") / NEAR_OFFSETS) * 2, F.floor((F.col("shift") + half) / NEAR_OFFSETS) * 2 + 1))
    grouped = aligned.withColumn("group", group).groupBy("i", "g", "item", "n", "group").agg(F.collect_list(F.struct("shift", "p")).alias("runs"))
    need = F.when(F.col("n") < WINDOW, F.col("n")).otherwise(F.least(F.lit(LEAK_WORDS), F.greatest(F.lit(WINDOW), F.col("n") - 1)))
    grouped = grouped.withColumn("need", need)
    grouped = durable(grouped.where(F.size(F.array_distinct(F.flatten("runs.p"))) >= F.col("need")))

    hit = grouped.select("g").distinct()
    texts = rows.join(hit.hint("shuffle_hash"), "g", "left_semi").dropDuplicates(["g"]).select("g", tokens(valued(F.col("x"))).alias("dv"))
    both = durable(grouped.join(texts, "g").join(items.select("item", "iv"), "item"))

    def judged(run):
        """The places of a run that count, and those of its longest verbatim stretch."""

        def of(s):
            pairs = F.transform(F.sequence(s["first"], s["last"]), lambda j: F.struct(j.alias("j"), F.get("iv", j).alias("a"), F.get("dv", j + run["shift"]).alias("b")))

            def tell(ps):
                values = F.array_distinct(F.transform(F.filter(ps, lambda x: x["a"].startswith("#")), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))))
                one = F.size(F.array_distinct(F.transform(values, lambda x: x["a"]))) == F.size(values)
                same = F.transform(F.filter(ps, lambda x: x["a"].eqNullSafe(x["b"])), lambda x: x["j"])
                whole = F.filter(_stretches(same), lambda x: x["last"] - x["first"] + 1 >= F.col("need"))
                return F.when(one, F.transform(ps, lambda x: x["j"])).otherwise(F.flatten(F.transform(whole, lambda x: F.sequence(x["first"], x["last"]))))

            return let(pairs, tell)

        return F.transform(_stretches(run["p"]), of)

    counted = F.transform("runs", lambda r: F.struct(r["shift"].alias("shift"), F.flatten(judged(r)).alias("p")))
    both = both.withColumn("runs", counted).withColumn("cover", F.array_distinct(F.flatten("runs.p")))
    pairs = F.flatten(F.transform("runs", lambda r: F.transform(r["p"], lambda j: F.struct(F.get("iv", j).alias("a"), F.get("dv", j + r["shift"]).alias("b")))))
    changed = F.size(F.filter(pairs, lambda x: ~x["a"].eqNullSafe(x["b"])))
    n_slots = F.size(F.filter("cover", lambda j: F.get("iv", j).startswith("#")))
    good = both.where(F.size("cover") >= F.col("need")).select("i", "g", F.col("item.id").alias("item"), "n", F.size("cover").alias("words"), n_slots.alias("slots"), changed.alias("changed"))
    best = good.groupBy("i", "g", "item").agg(F.max(F.struct("words", (-F.col("changed")).alias("same"), "slots", "n")).alias("m"))
    release(probes)
    return best.select(
        F.when(F.col("i") != NULL_ID, F.col("i")).alias("doc_id"),
        F.col("item").alias("item_id"),
        F.col("m.words").cast("long").alias("matched_words"),
        F.col("m.n").cast("long").alias("item_words"),
        F.col("m.slots").cast("long").alias("slots"),
        (F.col("m.same") == 0).alias("verbatim"),
        F.col("g").alias("row_key"),
    )
