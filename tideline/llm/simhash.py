"""SimHash near-duplicates by meet-in-the-middle ball hashing, first on halves.

A fingerprint has the majority bits of a text's shingle hashes. Of two fingerprints that differ in at most RADIUS bits, one half
(32 bits) differs in at most half as many, so a value lies between these halves, within a quarter of the radius of both. Every distinct
fingerprint emits all values in that ball for each half (2 times 33 of them at 64 bits and radius 4); values meet in a shuffle, the
fingerprints that emit the same value are compared, and close ones that nothing connects yet are linked.

Scale: only distinct fingerprints emit, 9 bytes an emission, whatever the documents: the emission with its half on top, and the number of
the flipped bit, from which the fingerprint is got back. A task of fingerprints sends one packed block for each part; parts grow in number
with the fingerprints, HALF_PART emissions to a part. The members of a value are compared with each other if they are at most
CROWD. If they are more, comparing would grow with their square: all fingerprints of such values go the longer way instead.

The longer way: two fingerprints have a value between them within half the radius of both, so each emits its whole ball of that
radius (2,081 values). All that emit such a value lie within the radius of each other, so links to the smallest of them lose nothing,
no pairs are listed within a group, and a value is emitted at most as often as its own ball has members. An emission takes 8 bytes: values
are spread by a multiplication, whose top bits name a slice; the rest stands beside the number of the flipped bits. Slices grow
in number with the fingerprints, PART emissions to a group of slices, and are handled in ROUNDS jobs, so the shuffle of one job lies on the disks at
a time. Links are whole for any number of parts, slices, rounds or crowded values."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import components, durable, release

BITS, RADIUS, SEED = 64, 4, 42
SHINGLE_WORDS = 4
#: Bits of a flip's number, emissions of a group, jobs (a power of two), fingerprints of a task and those expanded at a time.
FLIP_BITS, PART, ROUNDS, TASK, AT_ONCE = 12, 1 << 20, 4, 4096, 2048
#: On halves: their bits, emissions of a part, fingerprints of a task and expanded at a time, and fingerprints at one value that are compared.
HALF, HALF_PART, HALF_TASK, CROWD = BITS // 2, 1 << 16, 8192, 512
_RECORD = np.dtype([("x", np.uint64), ("flip", np.uint8)])
_ODD = tk.U(0x9E3779B97F4A7C15)
_BLOCK = 1 << 16
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def flips(bits: int = BITS, most: int = RADIUS // 2):
    """All masks of at most `most` set bits, 0 first."""
    layers = [np.zeros(1, np.uint64)]
    one = tk.U(1) << np.arange(bits, dtype=np.uint64)
    for _ in range(most):  # the next bit is above all others
        layers.append(np.concatenate([m[None] | one[one > m] for m in layers[-1]]))
    return np.concatenate(layers)


FLIPS = flips()
HALF_FLIPS = flips(HALF, RADIUS // 4) << tk.U(HALF)


def majority(h, row, rows):
    """The fingerprint of each of `rows` rows: bits set in over half of the row's hashes h (row: whose each is, ascending)."""
    ones, n = np.zeros((rows, BITS), np.int64), np.bincount(row, minlength=rows)
    for lo in range(0, len(h), _BLOCK):
        r = row[lo : lo + _BLOCK]
        bits = np.unpackbits(h[lo : lo + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        head = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        ones[r[head]] += np.add.reduceat(bits, head, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)


def _fingerprints(k):
    """Arrow mapper: (id, text) to id and fingerprint."""

    def run(batches):
        for batch in batches:
            for lo, body, offsets in tk.slabs(batch.column(1)):
                w = tk.Words(body, offsets, lower=True)
                kept = ~tk._SEP[w.body]
                kept[w.ends[w.ends < len(kept)]] = True
                at = np.cumsum(kept) - kept  # words stand one byte apart, as joined by spaces
                joined = np.where(tk._SEP[w.body], 32, w.body)[kept].astype(np.uint8).tobytes()
                n = np.diff(w.first)
                count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
                row = np.repeat(np.arange(len(n)), count)
                first = w.first[:-1][row] + np.arange(len(row)) - np.r_[0, np.cumsum(count)][row]
                last = first + np.minimum(k, n[row]) - 1
                starts = at[w.starts[first]]
                ends = at[w.starts[last]] + w.ends[last] - w.starts[last]
                digest = xxhash.xxh64_intdigest
                h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(row))
                found = majority(h, row, len(n)).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(n)), pa.array(found)], names=["i", "f"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row for each row of docs: doc_id and simhash (64 bits, as a long)."""
    one = docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").alias("x"))
    return one.mapInArrow(_fingerprints(shingle_words), "i long, f long").select(F.col("i").alias("doc_id"), F.col("f").alias("simhash"))


def _turned(f, half):
    """Fingerprints with this half (0: high, 1: low) on top; its own inverse."""
    return (f << tk.U(HALF)) | (f >> tk.U(HALF)) if half else f


def _emit_halves(part_bits):
    """Arrow mapper: fingerprints to packed blocks (part, records) of the values near their halves; the lowest bit of a part tells which half."""
    kind = np.uint16 if part_bits <= 16 else np.uint32

    def run(batches):
        for batch in batches:
            f = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(f), HALF_TASK):
                for half in (0, 1):
                    x = _turned(f[lo : lo + HALF_TASK], half)[:, None] ^ HALF_FLIPS[None, :]
                    record = np.empty(x.shape, _RECORD)
                    record["x"], record["flip"] = x, np.arange(len(HALF_FLIPS))
                    at = (((x >> tk.U(HALF)) * _ODD) >> tk.U(64 - part_bits)).astype(kind).reshape(-1)
                    order = np.argsort(at, kind="stable")
                    at = at[order]
                    head = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                    cut = np.r_[head, len(at)] * _RECORD.itemsize
                    body = pa.py_buffer(record.reshape(-1)[order].tobytes())
                    blocks = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(cut.astype(np.int32)), body])
                    yield pa.RecordBatch.from_arrays([pa.array(at[head].astype(np.int64) * 2 + half), blocks], names=["part", "block"])

    return run


def _joined(root, a, b):
    """root (of each place the smallest of its set) once the sets of a and b are joined, pair by pair."""
    while len(a):
        u, v = root[a], root[b]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while np.any((up := root[root]) != root):
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def _meet_in_half(crowd):
    """Arrow group mapper: a part's blocks to links (u, v), u over v, of fingerprints within RADIUS that emit one value: those that connect
    all such pairs. Where over `crowd` emit one value, each of them as (u, u) instead."""

    def run(table):
        half = table.column("part")[0].as_py() & 1
        record = np.frombuffer(b"".join(x.as_buffer() for x in table.column("block")), _RECORD)
        record = record[np.argsort(record["x"])]
        flip, value = record["flip"], record["x"] >> tk.U(HALF)
        f = _turned(record["x"] ^ HALF_FLIPS[flip], half)
        head = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        size = np.diff(np.r_[head, len(f)])
        end, many = np.repeat(head + size, size), np.repeat(size > crowd, size)
        root, i, step = np.arange(len(f)), np.flatnonzero(~many), 1
        found = [np.stack([f[many]] * 2, axis=1)]
        while len(i := i[i + step < end[i]]):
            j = i + step
            met = (flip[i] != flip[j]) | (flip[i] == 0)  # the same flip: the same half, which meets unflipped too
            met &= (np.bitwise_count(f[i] ^ f[j]) <= RADIUS) & (root[i] != root[j])
            found.append(np.stack([f[i[met]], f[j[met]]], axis=1))
            root = _joined(root, i[met], j[met])
            step += 1
        pairs = np.unique(np.sort(np.concatenate(found).view(np.int64), axis=1), axis=0)
        return pa.table({"u": pa.array(pairs[:, 1]), "v": pa.array(pairs[:, 0])})

    return run


def _emit(slice_bits, parts, turn):
    """Arrow mapper: fingerprints to packed blocks (part, slice, records) of this turn's parts."""
    s = tk.U(slice_bits)
    kind = np.uint16 if slice_bits <= 16 else np.uint32
    number = np.broadcast_to(np.arange(len(FLIPS), dtype=np.uint64), (AT_ONCE, len(FLIPS)))

    def run(batches):
        for batch in batches:
            f = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(f), AT_ONCE):
                some = f[lo : lo + AT_ONCE]
                y = (some[:, None] ^ FLIPS[None, :]) * _ODD
                now = (y >> (tk.U(64) - s)) & tk.U(ROUNDS - 1) == tk.U(turn)  # of the part, whose number is the slice's low bits
                y, m = y[now], number[: len(some)][now]
                at = (y >> (tk.U(64) - s)).astype(kind)
                order = np.argsort(at, kind="stable")
                record = (((y << s) >> (s - tk.U(FLIP_BITS))) | m)[order]
                at = at[order]
                head = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                cut = np.r_[head, len(at)] * 8
                name = at[head].astype(np.int64)
                blocks = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(record)])
                yield pa.RecordBatch.from_arrays([pa.array(name & (parts - 1)), pa.array(name), blocks], names=["part", "slice", "block"])

    return run


def _meet(slice_bits):
    """Arrow group mapper: a part's blocks to links (u, v) of fingerprints that emit one value, v the smallest of them."""

    def run(table):
        s, back = tk.U(slice_bits), tk.inverse(_ODD)
        names = table.column("slice").to_numpy()
        blocks = table.column("block").combine_chunks()
        order = np.argsort(names, kind="stable")
        cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(names[order]) != 0]), len(order)]
        found = [np.zeros((0, 2), np.int64)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            record = np.sort(np.frombuffer(b"".join(blocks[k].as_buffer() for k in order[a:b].tolist()), np.uint64))
            value = record >> tk.U(FLIP_BITS)
            same = np.r_[False, value[1:] == value[:-1]]
            met = same | np.r_[same[1:], False]
            if not met.any():
                continue
            y = value[met] | (tk.U(int(names[order[a]])) << (tk.U(64) - s))
            f = ((y * back) ^ FLIPS[(record[met] & tk.U((1 << FLIP_BITS) - 1)).astype(np.int64)]).view(np.int64)
            head = np.flatnonzero(~same[met])
            low = np.repeat(np.minimum.reduceat(f, head), np.diff(np.r_[head, len(f)]))
            pairs = np.stack([f, low], axis=1)[f != low]
            found.append(np.unique(pairs, axis=0))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"u": pa.array(pairs[:, 0]), "v": pa.array(pairs[:, 1])})

    return run


@contextmanager
def _shuffles_end(spark: SparkSession):
    """Shuffle files of frames made in here go when their job ends, not when the driver next collects garbage."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def _near_by_balls(distinct: DataFrame) -> DataFrame:
    """near_fingerprints by whole balls: no comparison, but 2,081 emissions a fingerprint."""
    fingerprint = durable(distinct.toDF("f"))
    n = fingerprint.count()
    emitted = n * len(FLIPS)
    part_bits = max(ROUNDS.bit_length() - 1, (emitted // PART).bit_length())
    parts, slice_bits = 1 << part_bits, max(FLIP_BITS, part_bits)
    links = []
    with _shuffles_end(distinct.sparkSession):
        for turn in range(ROUNDS):
            sent = fingerprint.repartition(1 + n // TASK).mapInArrow(_emit(slice_bits, parts, turn), "part long, slice long, block binary")
            met = sent.groupBy("part").applyInArrow(_meet(slice_bits), "u long, v long").distinct()
            links.append(durable(met.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)))
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    out = durable(every.distinct())
    release(fingerprint, *links)
    return out


def near_fingerprints(distinct: DataFrame) -> DataFrame:
    """distinct: one column of distinct 64-bit fingerprints. Links (u, v), each once, whose components are those of all
    pairs that differ in at most RADIUS bits; every link is such a pair."""
    fingerprint = durable(distinct.toDF("f"))
    n = fingerprint.count()
    part_bits = max(1, (n * len(HALF_FLIPS) // HALF_PART).bit_length())
    with _shuffles_end(distinct.sparkSession):
        sent = fingerprint.repartition(1 + n // HALF_TASK).mapInArrow(_emit_halves(part_bits), "part long, block binary")
        met = durable(sent.groupBy("part").applyInArrow(_meet_in_half(CROWD), "u long, v long").distinct())
    release(fingerprint)
    links, crowded = met.where("u <> v"), met.where("u = v").select("u")
    if crowded.isEmpty():
        links.tideline_path = met.tideline_path
        return links
    balls = _near_by_balls(crowded)
    out = durable(links.unionByName(balls).distinct())
    release(met, balls)
    return out


def simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row for each row of docs: doc_id, simhash (long), fingerprint (its 16 lower-case hex digits), component_id, component_key.

    A-Z are lower-cased; shingles are runs of words joined by one space, repeats included, hashed by XXH64 with seed 42; a
    bit is set if it is in over half of the hashes. Fingerprints that differ in at most 4 bits are linked; component_id is
    the smallest id reachable over links, itself included; component_key is the same for all rows of a component. Defined
    cases: fewer words than a shingle make one shingle; null texts and texts without words have fingerprint zero, linked like any
    other; rows that share an id each have their own fingerprint; a null id links like others but names no component, which
    is null if it has such rows alone; equal rows have equal results; a text of any length is read whole, in one task's memory at about 120
    times its bytes; an empty table gives an empty one; other columns are ignored."""
    feats = durable(fingerprints(docs, id_col, text_col, shingle_words))
    classes = durable(feats.groupBy("simhash").agg(F.min("doc_id").alias("least")))
    links = near_fingerprints(classes.select("simhash"))
    roots = components(links)
    named = classes.join(roots.select(F.col("u").alias("simhash"), "root"), "simhash", "left")
    named = durable(named.select("simhash", "least", F.coalesce("root", "simhash").alias("root")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    told = durable(named.select("simhash", "root").join(least, "root"))
    release(links, roots, named, classes)
    return feats.join(told, "simhash").select(
        "doc_id", "simhash", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id", F.col("root").alias("component_key")
    )
