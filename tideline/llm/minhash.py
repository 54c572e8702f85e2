"""Near-duplicate groups by b-bit MinHash.

Each document's set of word shingles gives PERMS minima; bands of ROWS whole minima name
candidate buckets, and the low BITS of every minimum are packed into longs, from which XOR and bit
counts estimate similarity, corrected for chance collisions. Estimates only rule pairs out, at SURE
standard deviations under the threshold; what is left is confirmed on the full shingle sets of whole
texts. At similarity 0.75 a pair shares no bucket with probability 5e-6.

Scale: rows with equal sets count as one class before anything is paired; classes are keyed by 64 bits
of their sets. The work goes in linear steps to ever fewer classes, none of them capped:

- Peeling: a link needs a share of common shingles, so shingles that no other class in a shared bucket has don't
  count for a class. Classes whose other shingles can't suffice for any size of partner in their buckets go.
- Pivot rounds: in every open bucket (one that holds several components) members meet one pivot, from the component with
  the smallest id; each class confirms the pivot that it meets most, and linked components are merged.
- What is left, the borders of dense groups, is joined inside its buckets: a pair passes only in its first
  common band, with sizes and counts that allow a link, and if a longer signature of LONG_PERMS one-bit
  minima, made for these classes alone, doesn't rule it out.

Hot buckets and hubs sit in joins that AQE can split, sums are pre-aggregated, and links, signatures and
components never leave the executors. Texts are read twice, the second time for classes with a bucket in common."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import NULL_ID, components, durable, placed, release, row_key

PERMS, BITS, ROWS, BANDS = 512, 2, 4, 32
LONGS = PERMS * BITS // 64
LONG_PERMS, SURE = 4096, 4.5
PIVOT_ROUNDS = 2
_ODD = np.random.default_rng(977).integers(1, 1 << 63, LONG_PERMS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(column, k):
    """(first row, distinct sorted shingle hashes of each row) slab by slab; texts of fewer than k
    words have their whole sequence as one shingle, texts without words none."""
    for lo, body, offsets in tk.slabs(column):
        w = tk.Words(body, offsets, lower=True)
        h = w.hashes()
        s = tk.run_hashes(h, k)
        sets = []
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
            if b - a >= k:
                x = np.sort(s[a : b - k + 1])
                sets.append(x[np.r_[True, x[1:] != x[:-1]]])
            elif b > a:
                x = tk.U(b - a)
                for v in h[a:b]:
                    x = tk.mix(np.array([x ^ v], np.uint64) * tk.U(3))[0]
                sets.append(np.array([x], np.uint64))
            else:
                sets.append(np.zeros(0, np.uint64))
        yield lo, sets


def _minima(flat, head, perms):
    """The least of each set's values under each of the first `perms` hashes."""
    low = np.empty((perms, len(head)), np.uint64)
    for p in range(perms):
        np.minimum.reduceat(flat * _ODD[p], head, out=low[p])
    return low


def _packed(low, bits):
    """The low bits of mixed minima, rows' signatures as longs."""
    per = 64 // bits
    small = tk.mix(low) & tk.U((1 << bits) - 1)
    sig = np.zeros((low.shape[1], low.shape[0] // per), np.uint64)
    for r in range(per):
        sig |= small[r::per].T << tk.U(bits * r)
    return sig


def _lists(x):
    """A two-dimensional array as a list column."""
    return pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1).view(np.int64)), x.shape[1]).cast(pa.list_(pa.int64()))


def _features(k):
    """Arrow mapper: (id, row key, place, text) to size, key of the set, band keys and packed signature."""

    def run(batches):
        for batch in batches:
            sizes, classes, bands, packed = [], [], [], []
            for _, sets in shingle_sets(batch.column(3), k):
                n = np.array([len(x) for x in sets])
                full = np.flatnonzero(n)
                key = np.zeros(len(n), np.uint64)
                band, sig = np.zeros((len(n), BANDS), np.uint64), np.zeros((len(n), LONGS), np.uint64)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    head = np.r_[0, np.cumsum(n[full])[:-1]]
                    one = np.add.reduceat(tk.mix(flat), head)
                    two = np.add.reduceat(tk.mix(flat ^ tk.U(0xA5A5A5A5A5A5A5A5)), head)
                    key[full] = tk.mix(one ^ tk.mix(two + n[full].astype(np.uint64)))
                    low = _minima(flat, head, PERMS)
                    for b in range(BANDS):
                        name = np.full(len(full), b + 1, np.uint64)
                        for r in range(ROWS):
                            name = tk.mix(name ^ low[b * ROWS + r]) + low[b * ROWS + r]
                        band[full, b] = name
                    sig[full] = _packed(low, BITS)
                sizes.append(n)
                classes.append(key)
                bands.append(band)
                packed.append(sig)
            if sizes:
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array(np.concatenate(sizes), pa.int64()), pa.array(np.concatenate(classes).view(np.int64)), _lists(np.concatenate(bands)), _lists(np.concatenate(packed))],
                    names=["i", "g", "at", "n", "k", "bands", "sig"],
                )

    return run


def _sets(k):
    """Arrow mapper: the text, which is last, becomes its shingles."""

    def run(batches):
        for batch in batches:
            for lo, sets in shingle_sets(batch.column(batch.num_columns - 1), k):
                at = np.r_[0, np.cumsum([len(x) for x in sets])]
                values = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                part = batch.slice(lo, len(sets))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], values], names=[*part.schema.names[:-1], "s"])

    return run


def _rows_of(column):
    """The arrays of a list column."""
    at, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b].view(np.uint64) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _long_signatures(batches):
    """Arrow mapper: the shingles, which are last, become LONG_PERMS one-bit minima."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 128):
            part = batch.slice(lo, 128)
            sets = _rows_of(part.column(part.num_columns - 1))
            head = np.r_[0, np.cumsum([len(x) for x in sets])[:-1]]
            sig = _lists(_packed(_minima(np.concatenate(sets), head, LONG_PERMS), 1))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], sig], names=[*part.schema.names[:-1], "long"])


def _confirm(percent):
    """Arrow mapper: pairs with the shingles of both, last, to those that are links on full sets, without the shingles."""

    def run(batches):
        for batch in batches:
            left, right = _rows_of(batch.column(batch.num_columns - 2)), _rows_of(batch.column(batch.num_columns - 1))
            both = np.array([len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(left, right)], np.int64)
            either = np.array([len(a) + len(b) for a, b in zip(left, right)], np.int64) - both
            yield pa.RecordBatch.from_arrays(batch.columns[:-2], names=batch.schema.names[:-2]).filter(pa.array(100 * both >= percent * either))

    return run


def estimate(a: str, b: str):
    """Collision-corrected similarity of two packed signatures (array columns)."""
    ones = int(("0" * (BITS - 1) + "1") * (64 // BITS), 2)
    miss = None
    for j in range(LONGS):
        x = F.col(a)[j].bitwiseXOR(F.col(b)[j])
        for k in range(1, BITS):  # a minimum differs if any of its bits does
            x = x.bitwiseOR(F.shiftrightunsigned(F.col(a)[j].bitwiseXOR(F.col(b)[j]), k))
        x = x.bitwiseAND(F.lit(ones))
        miss = F.bit_count(x) if miss is None else miss + F.bit_count(x)
    chance = 2.0**-BITS
    return (1 - miss / F.lit(float(PERMS)) - chance) / (1 - chance)


def long_estimate(a: str, b: str):
    """The same of two long one-bit signatures."""
    miss = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return 1 - 2 * miss / F.lit(float(LONG_PERMS))


def _least(percent, perms, bits):
    """The estimate under which a pair at the threshold stays with probability 3e-6."""
    same = percent / 100 + (1 - percent / 100) * 2.0**-bits
    return percent / 100 - SURE * (same * (1 - same) / perms) ** 0.5 / (1 - 2.0**-bits)


class _Search:
    """Links between classes. cand has every class in a shared bucket: its key k, smallest id i, size n, sig, bands and
    shingles s. Members are rows of open buckets: bucket b, k, n, component c (the key of one of its classes) and its
    smallest id ci, a (shingles of k that others have too), least (size in the bucket)."""

    def __init__(self, cand, percent):
        self.cand, self.percent = cand, percent

    def opened(self, m):
        """The members m of buckets with several components."""
        mixed = m.groupBy("b").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("n").alias("least")).where("lo <> hi").select("b", "least")
        out = durable(m.join(mixed, "b"))
        release(m)
        return out

    def peeled(self, buckets):
        """Members that may have a link; each class is its own component yet."""
        p = self.percent
        sets = self.cand.select("k", F.explode("s").alias("s"))
        alone = sets.groupBy("s").agg(F.count("*").alias("n"), F.min("k").alias("k")).where("n = 1").groupBy("k").agg(F.count("*").alias("alone"))
        told = self.cand.select("k", "i", "n").join(alone, "k", "left").select("k", F.col("i").alias("ci"), "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("a"))
        # a partner has at least percent of n, and all shingles in common are among a
        told = told.where((100 + p) * F.col("a") >= p * (F.col("n") + F.ceil(F.col("n") * (p / 100))))
        return self.opened(durable(buckets.join(told, "k").withColumn("c", F.col("k"))))

    def confirmed(self, pairs, *conditions):
        """pairs: u, v and components c, d. Those that pass the conditions and are links on full sets."""
        one = self.cand.select(F.col("k").alias("u"), F.col("sig").alias("sig1"), F.col("s").alias("s1"))
        two = self.cand.select(F.col("k").alias("v"), F.col("sig").alias("sig2"), F.col("s").alias("s2"))
        met = pairs.join(one, "u").join(two, "v")
        for c in conditions:
            met = met.where(c)
        kind = "c long, d long, di long"
        return durable(met.select("c", "d", "di", "s1", "s2").mapInArrow(_confirm(self.percent), kind))

    def pivots(self, m, turn):
        """Links of each member with the pivot of another component that it meets in most buckets."""
        first = F.min(F.struct("ci", "c", F.xxhash64(F.lit(turn), "k").alias("h"), "k")).alias("p")
        met = m.join(m.groupBy("b").agg(first), "b").where("c <> p.c")
        votes = met.groupBy(F.col("k").alias("u"), "c", F.col("p.k").alias("v"), F.col("p.c").alias("d"), F.col("p.ci").alias("di")).agg(F.count("*").alias("n"))
        best = votes.groupBy("u", "c").agg(F.max(F.struct("n", "v", "d", "di")).alias("m")).select("u", "c", "m.v", "m.d", "m.di")
        best = durable(best)
        out = self.confirmed(best, estimate("sig1", "sig2") >= _least(self.percent, PERMS, BITS))
        release(best)
        return out

    def merged(self, m, links):
        """Members with components merged along links. A component's link leads to one with a smaller
        id (or key), so links make a forest, and doubling its steps ends at the roots."""
        steps = durable(links.groupBy("c").agg(F.min(F.struct("di", "d")).alias("t")).select("c", "t.d", "t.di"))
        while True:
            on = steps.select(F.col("c").alias("d"), F.col("d").alias("e"), F.col("di").alias("ei"))
            further = durable(steps.join(on, "d", "left").select("c", F.coalesce("e", "d").alias("d"), F.coalesce("ei", "di").alias("di"), F.col("e").isNotNull().alias("moved")))
            release(steps)
            moved = further.where("moved").limit(1).count()
            steps = further
            if not moved:
                break
        told = m.drop("least").join(steps.drop("moved"), "c", "left")
        out = durable(told.select("b", "k", "n", "a", F.coalesce("d", "c").alias("c"), F.coalesce("di", "ci").alias("ci")))
        release(m, steps)
        return self.opened(out)

    def rest(self, m):
        """Links between what is left, every pair of components' members in a bucket."""
        p = self.percent
        own = durable(m.select("k").distinct().join(self.cand.select("k", "sig", "bands", "s"), "k").mapInArrow(_long_signatures, "k long, sig array<long>, bands array<long>, long array<long>"))
        told = durable(m.drop("least").join(own, "k"))
        right = told.select("b", *[F.col(c).alias(f"{c}2") for c in ("k", "c", "ci", "n", "a", "sig", "bands", "long")])
        may = (100 + p) * F.least("a", "a2") >= p * (F.col("n") + F.col("n2"))
        first = F.array_intersect("bands", "bands2")[0] == F.col("b")
        near = (estimate("sig", "sig2") >= _least(p, PERMS, BITS)) & first & (long_estimate("long", "long2") >= _least(p, LONG_PERMS, 1))
        met = told.join(right, "b").where((F.col("k") < F.col("k2")) & (F.col("c") != F.col("c2")) & may & near)
        pairs = durable(met.select(F.col("k").alias("u"), F.col("k2").alias("v"), "c", F.col("c2").alias("d"), F.col("ci2").alias("di")))
        out = self.confirmed(pairs)
        release(own, told, pairs)
        return out


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 75
) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept, component_key, row_key.

    Links join documents whose shingle sets (A-Z lower-cased) have 100 * intersection >= percent *
    union; component_id is the smallest id reachable over links, kept is true for that document.
    Defined cases: documents without words have an empty set, link with nothing and are kept; fewer
    words than a shingle make one shingle; rows that share an id are told apart by their texts, each has its
    own links, and equal rows have equal results; rows with a null id link like others but name no component, and in a
    component of such rows alone (component_id null) those with one and the same set are kept; a
    text of any length is one set, held in one task's memory at about 30 times its bytes; an empty table
    gives an empty one; other columns are ignored. component_key is the same for all rows of a component, null for texts
    without words; row_key is row_key(id, text)."""
    docs, place = placed(docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.select(F.col(id_col).cast("long").alias("i"), row_key(id_col, text_col).alias("g"), place.alias("at"), text.alias("x"))
    feats = durable(whole.mapInArrow(_features(shingle_words), "i long, g binary, at long, n long, k long, bands array<long>, sig array<long>"))
    # a class has one set; the row with the smallest id stands for it
    stands = F.min(F.struct(F.coalesce("i", F.lit(NULL_ID)).alias("i"), "at", "n", "bands", "sig")).alias("r")
    classes = durable(feats.where("n > 0").groupBy("k").agg(stands).select("k", "r.*"))
    each = classes.select("k", F.explode("bands").alias("b"))
    shared = each.groupBy("b").agg(F.count("*").alias("c")).where("c > 1").select("b")
    buckets = durable(each.join(shared, "b"))
    used = classes.join(buckets.select("k").distinct(), "k", "left_semi")
    texts = whole.select("at", "x").join(used.hint("shuffle_hash"), "at").select("k", "i", "n", "sig", "bands", "x")
    cand = durable(texts.mapInArrow(_sets(shingle_words), "k long, i long, n long, sig array<long>, bands array<long>, s array<long>"))

    search = _Search(cand, percent)
    members, links = search.peeled(buckets), []
    for turn in range(PIVOT_ROUNDS):
        links.append(search.pivots(members, turn))
        members = search.merged(members, links[-1])
    if members.limit(1).count():
        links.append(search.rest(members))
    roots = components(_union(links).select(F.col("c").alias("u"), F.col("d").alias("v")))
    release(members, cand, buckets, *links)

    # the smallest id of each component, for its classes
    named = classes.select("k", "i").join(roots.select(F.col("u").alias("k"), "root"), "k", "left").select("k", "i", F.coalesce("root", "k").alias("root"))
    named = durable(named)
    least = named.groupBy("root").agg(F.min("i").alias("m"))
    told = durable(named.drop("i").join(least, "root"))
    release(roots, named, classes)
    m = F.when(F.col("m") != NULL_ID, F.col("m"))
    component = F.when(F.col("n") > 0, m).otherwise(F.col("i"))
    alone = F.when(F.col("n") > 0, F.col("k") == F.col("root")).otherwise(F.lit(True))
    return (
        feats.select("i", "g", "n", F.when(F.col("n") > 0, F.col("k")).alias("k"))
        .join(told, "k", "left")
        .select(
            F.col("i").alias("doc_id"),
            F.col("n").alias("n_shingles"),
            component.alias("component_id"),
            F.when(component.isNull(), alone).otherwise(F.col("i").eqNullSafe(component)).alias("kept"),
            F.col("root").alias("component_key"),
            F.col("g").alias("row_key"),
        )
    )


def _union(tables):
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
