"""Substring deduplication by seeds and extension.

Every window of `min_words` words holds one winnowed anchor: its smallest-hashed run of
ANCHOR_WORDS words, leftmost among equals. The anchor depends on the window's words alone, so all
copies of a window meet at one anchor, and only about two runs in eleven are anchors. An anchor is
a seed; with it travel fingerprints of the windows around it, its one-word steps of extension. Where documents meet at a seed,
each that isn't the first extends its match word by word to the left and to the right as long as the next window, too, is
in a document with a smaller id. What overlaps or touches is then joined into maximal repeats, which go.

Scale: a task first settles windows among its own rows and sends on each only from the smallest
document, packed by anchor bucket, so copies by the thousand add one record for each task. Anchors
that hold over 1/HOT_SHARE of all (in the borders of very common passages) are at most HOT_SHARE,
found by exact counts; their windows are dealt one by one instead. Buckets have about BUCKET_BYTES
whatever the input's size. Fingerprints have 96 bits beside the bucket; rows that share an id are told
apart by 64-bit hashes of their texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import NULL_ID, durable, partitions

ANCHOR_WORDS = 4
HOT_SHARE = 1024
BUCKET_BYTES = 512 << 10
FLUSH_WORDS = 1 << 20
_HEAD = np.dtype([("doc", "<i8"), ("anchor", "<u8"), ("at", "<i4"), ("tag", "<i8"), ("sent", "<u2"), ("gone", "<u2")])


def _windows(column, min_words):
    """(first row, row, at, anchor, fingerprint) of all windows, slab by slab."""
    k, wide = ANCHOR_WORDS, min_words - ANCHOR_WORDS + 1
    for lo, body, offsets in tk.slabs(column):
        w = tk.Words(body, offsets)
        if not len(w.starts) or np.diff(w.first).max() < min_words:
            continue
        h = w.hashes()
        whole = np.flatnonzero(tk.whole_runs(w.first, min_words))
        a = tk.run_hashes(h, k)
        n = len(h) - min_words + 1
        best, shift = a[:n].copy(), np.zeros(n, np.int64)
        for s in range(1, wide):
            less = a[s : s + n] < best
            np.copyto(best, a[s : s + n], where=less)
            shift[less] = s
        full = tk.run_hashes(h, min_words)
        row = np.searchsorted(w.first, whole, "right") - 1
        yield lo, row, whole - w.first[row], whole + shift[whole], best[whole], full[whole]


def _keys(batch):
    doc = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
    return doc, batch.column(2).to_numpy(zero_copy_only=False)


def _counts(min_words):
    """Arrow mapper: anchors with a notable share of the task's, and the task's total (anchor null)."""

    def run(batches):
        kept, total = [], 0
        for batch in batches:
            for _, _, _, where, anchor, _ in _windows(batch.column(0), min_words):
                new = np.ones(len(where), bool)
                new[1:] = where[1:] != where[:-1]
                got, n = np.unique(anchor[new], return_counts=True)
                total += int(n.sum())
                kept.append((got[n > 1], n[n > 1]))
        if total:
            keys, n = (np.concatenate(x) for x in zip(*kept))
            got, at = np.unique(keys, return_inverse=True)
            n = np.bincount(at, n, len(got)).astype(np.int64) if len(got) else np.zeros(0, np.int64)
            big = n * HOT_SHARE * 2 > total
            yield pa.RecordBatch.from_arrays(
                [pa.array([None, *got[big].view(np.int64).tolist()], pa.int64()), pa.array([total, *n[big].tolist()], pa.int64())],
                names=["anchor", "n"],
            )

    return run


def _seeds(min_words, hot, buckets):
    """Arrow mapper: (bucket, payload) with the seeds of a flush, settled among themselves."""
    hot = np.array(sorted(hot), np.uint64)

    def pack(parts):
        doc, tag, at, where, anchor, full = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(full, kind="stable")
        f = full[order]
        head = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
        least = np.minimum.reduceat(doc[order], head)
        gone = np.zeros(len(doc), bool)
        gone[order] = doc[order] > np.repeat(least, np.diff(np.r_[head, len(f)]))
        single = np.isin(anchor, hot) if len(hot) else np.zeros(len(doc), bool)
        new = np.ones(len(doc), bool)  # a record for each anchor's run of windows
        new[1:] = (where[1:] != where[:-1]) | (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (at[1:] != at[:-1] + 1) | single[1:] | single[:-1]
        begin = np.flatnonzero(new)
        bit = (1 << (np.arange(len(doc)) - np.repeat(begin, np.diff(np.r_[begin, len(doc)])))).astype(np.int64)
        rec = np.zeros(len(begin), _HEAD)
        rec["doc"], rec["tag"], rec["at"] = doc[begin], tag[begin], at[begin]
        rec["anchor"] = np.where(single[begin], tk.mix(anchor[begin] ^ full[begin]), anchor[begin])
        rec["sent"] = np.add.reduceat(bit * ~gone, begin)
        rec["gone"] = np.add.reduceat(bit * gone, begin)
        bucket = np.where(rec["sent"] > 0, rec["anchor"] % tk.U(buckets), tk.mix(doc[begin].astype(np.uint64)) % tk.U(buckets)).astype(np.int64)
        marks = (full >> tk.U(32)).astype(np.uint32)
        of = np.repeat(bucket, np.diff(np.r_[begin, len(doc)]))
        order, last = np.argsort(bucket, kind="stable"), np.argsort(of[~gone], kind="stable")
        rec, bucket, marks, of = rec[order], bucket[order], marks[~gone][last], of[~gone][last]
        names, lo = np.unique(bucket, return_index=True)
        hi, mlo, mhi = np.r_[lo[1:], len(bucket)], np.searchsorted(of, names), np.searchsorted(of, names, "right")
        out = []
        for i in range(len(names)):
            part = rec[lo[i] : hi[i]]
            out.append(len(part).to_bytes(4, "little") + b"".join(part[c].tobytes() for c in _HEAD.names) + marks[mlo[i] : mhi[i]].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(out, pa.binary())], names=["bucket", "payload"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            doc, tag = _keys(batch)
            for lo, row, at, where, anchor, full in _windows(batch.column(1), min_words):
                parts.append((doc[lo + row], tag[lo + row], at.astype(np.int32), where + (held << 1), anchor, full))
                held += len(row)
                if held >= FLUSH_WORDS:
                    yield pack(parts)
                    parts, held = [], 0
        if parts:
            yield pack(parts)

    return run


def _unpack(blob):
    n, at = int.from_bytes(blob[:4], "little"), 4
    rec = np.zeros(n, _HEAD)
    for c in _HEAD.names:
        rec[c] = np.frombuffer(blob, _HEAD[c], n, at)
        at += n * _HEAD[c].itemsize
    return rec, np.frombuffer(blob, np.uint32, -1, at)


def _late(rec, marks):
    """For each seed the windows around it, as bits, that a smaller document has too."""
    n = np.bitwise_count(rec["sent"]).astype(np.int64)
    of = np.repeat(np.arange(len(rec)), n)
    bit = np.nonzero((rec["sent"][:, None] >> np.arange(16, dtype=np.uint16)) & 1)[1]
    gone = rec["gone"].astype(np.int64)
    if len(of):
        order = np.lexsort((marks, rec["anchor"][of]))
        a, m, d = rec["anchor"][of][order], marks[order], rec["doc"][of][order]
        head = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (m[1:] != m[:-1])])
        least = np.repeat(np.minimum.reduceat(d, head), np.diff(np.r_[head, len(d)]))
        late = order[d > least]
        np.bitwise_or.at(gone, of[late], np.left_shift(1, bit[late]))
    return gone


def _extend(min_words):
    """The seeds of one bucket to the matches that they extend to: (document, tag, first and last word in one number)."""

    def run(table):
        rec, marks = (np.concatenate(x) for x in zip(*map(_unpack, table.column("payload").to_pylist())))
        gone = _late(rec, marks)
        # a match begins where the window to the left isn't one, and ends where that to the right isn't
        left, right = gone & ~(gone << 1), gone & ~(gone >> 1)
        bits = np.arange(17)
        row, first = np.nonzero((left[:, None] >> bits) & 1)
        _, last = np.nonzero((right[:, None] >> bits) & 1)
        at = rec["at"].astype(np.int64)[row]
        return pa.table({"d": rec["doc"][row], "t": rec["tag"][row], "m": ((at + first) << 32) | (at + last + min_words - 1)})

    return run


def _cut(min_words):
    """Arrow mapper: matches are joined into maximal repeats, which go; the rest, joined by one space, stays."""

    def run(batches):
        for batch in batches:
            n_words, n_removed, kept, spans = [], [], [], []
            marks = batch.column(3)
            for text, m in zip(batch.column(2).to_pylist(), marks):
                words = (text or "").encode().split()
                n = len(words)
                n_words.append(n)
                m = m.values.to_numpy() if m.is_valid else ()
                if not len(m):
                    n_removed.append(0)
                    spans.append([])
                    kept.append(b" ".join(words))
                    continue
                change = np.zeros(n + 1, np.int64)
                np.add.at(change, m >> 32, 1)
                np.add.at(change, (m & 0xFFFFFFFF) + 1, -1)
                gone = np.cumsum(change)[:n] > 0
                edge = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                spans.append([{"first": int(a), "last": int(b) - 1} for a, b in edge.reshape(-1, 2)])
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()]))
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, kind)],
                names=["doc_id", "n_words", "n_removed", "kept_text", "spans"],
            )

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 13) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_text, spans (first and last
    word of each maximal removed repeat).

    A word goes if a window of min_words words that covers it also starts in a document with a
    smaller id; windows are those of the input. Defined cases: null text has no words; a null id
    orders after all others and stays null; rows that share an id never remove each other's
    words, equal ones get equal results, and of documents that share a window all but those with the smallest id lose it;
    a text of any length is taken whole, at about 60 times its bytes in one task's memory; an empty table gives an empty
    one; other columns are ignored. Words are `[^\\x20\\x09-\\x0D]+`. min_words lies between 5 and 19."""
    if not ANCHOR_WORDS < min_words <= ANCHOR_WORDS + 15:
        raise ValueError("min_words must be between 5 and 19")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("x"))
    found = durable(rows.select("x").mapInArrow(_counts(min_words), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")))
    total = found.where("anchor is null").first()
    total = total.n if total else 0
    # at most HOT_SHARE rows: their counts add up to no more than the total
    hot = [r.anchor & (2**64 - 1) for r in found.where((F.col("anchor").isNotNull()) & (F.col("n") * HOT_SHARE > total)).collect()]
    buckets = max(4 * partitions(spark), total * 50 // BUCKET_BYTES)
    tag = F.xxhash64(F.coalesce("x", F.lit("")))
    marks = (
        rows.select("i", "x", tag.alias("t"))
        .mapInArrow(_seeds(min_words, hot, buckets), "bucket long, payload binary")
        .groupBy("bucket")
        .applyInArrow(_extend(min_words), "d long, t long, m long")
        .groupBy("d", "t")
        .agg(F.collect_list("m").alias("m"))
    )
    keyed = rows.select("i", "x", F.coalesce("i", F.lit(NULL_ID)).alias("d"), tag.alias("t"))
    return (
        keyed.join(marks, ["d", "t"], "left")
        .select("i", "d", "x", "m")
        .mapInArrow(_cut(min_words), "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<first:long,last:long>>")
    )
