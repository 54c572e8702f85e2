"""Language-model scores: prediction by partial matching over bytes, beside a word-unigram base.

The model is a byte-context trie of depth ORDER over the running text: words in lower case, one space after
each, and one end. A byte's context is the ORDER bytes before it, over word borders too; the text's
beginning counts as a byte of its own. In a context every distinct symbol gives up DISCOUNT of its count; these shares are
the odds of escape. A context that lacks the byte escapes to the context without its first byte, where the symbols that it
holds are excluded; below the root all bytes are equally likely. Counts come pretrained from the training rows. A document's score is its code length under them as a log10 probability.

Scale: rows are dealt evenly into chunks of about CHUNK_BYTES, by their place in the table, so no key can be hot. A chunk
sends each distinct word and each distinct context with symbol once: what is in all texts costs a record for
each chunk, and counts return the same way. Words are keyed by 64-bit hashes. The trie is never in one place:
contexts go to buckets by their last two bytes, where orders 2 to ORDER are complete and a bucket's part of the trie is
built once; orders 0 and 1 have at most 2^16 pairs of bytes, whatever the corpus, and are broadcast. All counts
cover all rows and have no bound. Texts are taken in slabs; one text needs about 60 times its bytes in its task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import durable, partitions, placed, release

ORDER, DISCOUNT = 5, 0.3
CHUNK_BYTES, BUCKET_WORDS = 16 << 20, 1 << 18
PAD, END, SPACE = 0xFE, 0xFF, 0x20
_END_KEY = 0x1B873593CC9E2D51
_MASK = [(1 << (8 * (k + 1))) - 1 for k in range(ORDER + 1)]


def _slabs(column):
    """(first row, words before each row, words' hashes, contexts with symbol as integers, each row's first
    of these) of a column's slabs."""
    for lo, body, offsets in tk.slabs(column):
        w = tk.Words(body, offsets, lower=True)
        rows = len(offsets) - 1
        at = np.flatnonzero(~tk._SEP[w.body])
        size = w.ends - w.starts
        row = w.rows()
        # a row's stream: ORDER pads, its words with a space behind each, an end
        shift = np.arange(len(size)) + row * (ORDER + 1) + ORDER
        stream = np.full(len(at) + len(size) + rows * (ORDER + 1), PAD, np.uint8)
        stream[np.arange(len(at)) + np.repeat(shift, size)] = w.body[at]
        stream[np.cumsum(size) + shift] = SPACE
        symbols = np.bincount(row, size + 1, rows).astype(np.int64) + 1
        stream[np.cumsum(symbols + ORDER) - 1] = END
        code = np.zeros(len(stream), np.uint64)
        for k in range(ORDER, -1, -1):
            code[ORDER:] |= stream[ORDER - k : len(stream) - k].astype(np.uint64) << tk.U(8 * k)
        yield lo, w.first, w.hashes(), code[stream != PAD], np.r_[0, np.cumsum(symbols)[:-1]]


def _tally(keys, learnt):
    """Distinct keys of under 63 bits, and how often each is learnt."""
    both = np.sort((keys << tk.U(1)) | learnt.astype(np.uint64))
    key, yes = both >> tk.U(1), (both & tk.U(1)).astype(np.int64)
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[head], np.add.reduceat(yes, head) if len(head) else yes


def _merged(parts):
    """Sums of counts by key over (keys, counts)."""
    keys, to = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(to, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _gram_buckets(grams, buckets):
    """The bucket of each code, by the last two bytes of its context."""
    return (tk.mix((grams >> tk.U(8)) & tk.U(0xFFFF)) % tk.U(buckets)).astype(np.int64)


def _planes(x):
    """Numbers as bytes, first all their lowest bytes, and so on: what is alike lies together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _numbers(blob, kind):
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def _packed(keys, n, bucket):
    """For each bucket its keys and counts as bytes, in the order of the keys."""
    by = np.argsort(bucket, kind="stable")
    keys, n, bucket = keys[by], n[by], bucket[by]
    names, lo = np.unique(bucket, return_index=True)
    return {k: (_planes(keys[a:b]), _planes(n[a:b])) for k, a, b in zip(names.tolist(), lo, np.r_[lo[1:], len(bucket)])}


def _gather(buckets):
    """Chunk to records for buckets, each with words (hash, training count) and grams (code, count); and
    one record (bucket null) with the counts of orders 0 and 1 as pairs of bytes."""

    def run(table):
        chunk, trains = table.column("chunk")[0], table.column("train").to_numpy()
        words, grams = [], []
        for lo, first, h, code, begin in _slabs(table.column("x")):
            learnt = trains[lo : lo + len(begin)]
            keys, to = np.unique(h, return_inverse=True)
            words.append((keys, np.bincount(to, np.repeat(learnt, np.diff(first)), len(keys)).astype(np.int64)))
            grams.append(_tally(code, np.repeat(learnt, np.diff(np.r_[begin, len(code)]))))
            if sum(len(k) for k, _ in grams[1:]) > len(grams[0][0]) + tk.SLAB:
                words, grams = [_merged(words)], [_merged(grams)]
        words.append((np.array([_END_KEY], np.uint64), np.array([trains.sum()])))
        keys, n = _merged(words)
        codes, m = _merged(grams)
        pairs, to = np.unique(codes & tk.U(_MASK[1]), return_inverse=True)
        low = pairs.tobytes() + np.bincount(to, m, len(pairs)).astype(np.int64).tobytes()
        words = _packed(keys, n, (keys % tk.U(buckets)).astype(np.int64))
        grams = _packed(codes, m, _gram_buckets(codes, buckets))
        names, none = sorted(words.keys() | grams.keys()), (b"", b"")
        column = lambda packed, j: pa.array([*(packed.get(k, none)[j] for k in names), None], pa.binary())
        return pa.table(
            {
                "bucket": pa.array([*names, None], pa.int64()),
                "chunk": pa.array([chunk.as_py()] * (len(names) + 1), pa.int64()),
                "words": column(words, 0), "word_counts": column(words, 1), "grams": column(grams, 0), "gram_counts": column(grams, 1),
                "low": pa.array([None] * len(names) + [low], pa.binary()),
            }
        )

    return run


def _summed(keys, counts):
    """Sizes of the blobs, distinct keys, each one's place among them, and their counts."""
    keys = [_numbers(b, np.uint64) for b in keys.to_pylist()]
    counts = np.concatenate([_numbers(b, np.int64) for b in counts.to_pylist()])
    found, to = np.unique(np.concatenate(keys), return_inverse=True)
    return [len(k) for k in keys], found, to, np.bincount(to, counts, len(found)).astype(np.int64)


def _answer(low):
    """Bucket to replies for its chunks, in the order in which words and grams were sent: the words' counts, the
    odds of grams; and a row (chunk null) with the bucket's tokens and distinct words."""

    def run(table):
        bucket, chunks = table.column("bucket")[0].as_py(), table.column("chunk").to_pylist()
        sizes, _, to, n = _summed(table.column("words"), table.column("word_counts"))
        counts = np.split(n[to], np.cumsum(sizes)[:-1])
        sent, codes, at, m = _summed(table.column("grams"), table.column("gram_counts"))
        odds = np.split(Trie(codes[m > 0], m[m > 0], *low.value).log10(codes)[at], np.cumsum(sent)[:-1])
        return pa.table(
            {
                "chunk": pa.array([*chunks, None], pa.int64()),
                "bucket": pa.array([bucket] * (len(chunks) + 1), pa.int64()),
                "counts": pa.array([*map(_planes, counts), None], pa.binary()),
                "odds": pa.array([*map(_planes, odds), None], pa.binary()),
                "tokens": pa.array([None] * len(chunks) + [int(n.sum())], pa.int64()),
                "words": pa.array([None] * len(chunks) + [int((n > 0).sum())], pa.int64()),
            }
        )

    return run


def _low_rows(batches):
    """Counts of pairs of bytes, added up over the task."""
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            both = np.frombuffer(blob, np.uint64)
            total[both[: len(both) // 2].astype(np.int64)] += both[len(both) // 2 :].view(np.int64)
    pair = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(total[pair])], names=["pair", "n"])


class Trie:
    """Levels 0..ORDER: sorted codes of contexts with symbol and counts; of contexts, their total,
    distinct symbols, and the count that those symbols have one level down. Levels 0 and 1 come from
    the corpus's pairs of bytes, the others from codes, which need only hold all those with the last two
    bytes of context that are asked for."""

    def __init__(self, codes, counts, low, low_counts):
        self.pairs, self.contexts = [], []
        for k in range(ORDER + 1):
            source, weights = (low, low_counts) if k < 2 else (codes, counts)
            pair, to = np.unique(source & tk.U(_MASK[k]), return_inverse=True)
            n = np.bincount(to, weights, len(pair)).astype(np.float64)
            ctx, to = np.unique(pair >> tk.U(8), return_inverse=True)
            below = self.pairs[-1][1][np.searchsorted(self.pairs[-1][0], pair & tk.U(_MASK[k - 1]))] if k else np.zeros(len(pair))
            sums = [np.bincount(to, w, len(ctx)) for w in (n, np.ones(len(pair)), below)]
            self.pairs.append((pair, n))
            self.contexts.append((ctx, *sums))

    def log10(self, codes):
        """log10 odds of each code's symbol in its context."""
        codes, to = np.unique(codes, return_inverse=True)
        out, open_ = np.zeros(len(codes)), np.ones(len(codes), bool)
        cut, gone = np.zeros(len(codes)), np.zeros(len(codes))  # excluded: counts, symbols
        for k in range(ORDER, -1, -1):
            ctx, total, kinds, below = self.contexts[k]
            pair, n = self.pairs[k]
            if not len(ctx):
                continue
            c = (codes & tk.U(_MASK[k])) >> tk.U(8)
            at = np.minimum(np.searchsorted(ctx, c), len(ctx) - 1)
            here = open_ & (ctx[at] == c)
            t, d = total[at] - cut, kinds[at] - gone
            here &= d > 0
            p = np.minimum(np.searchsorted(pair, codes & tk.U(_MASK[k])), len(pair) - 1)
            hit = here & (pair[p] == codes & tk.U(_MASK[k]))
            out[hit] += np.log10((n[p][hit] - DISCOUNT) / t[hit])
            open_ &= ~hit
            miss = here & ~hit
            out[miss] += np.log10(DISCOUNT * d[miss] / t[miss])
            known = open_ & (ctx[at] == c)
            cut = np.where(known, below[at], 0.0)
            gone = np.where(known, kinds[at], 0.0)
        out[open_] += -np.log10(np.maximum(256 - gone[open_], 1))
        return out[to]


def _score(buckets):
    def run(left, right):
        right = right.sort_by("bucket")
        slabs = list(_distinct(left.column("x")))
        keys = np.unique(np.concatenate([k for k, _ in slabs] + [np.array([_END_KEY], np.uint64)]))
        codes = np.unique(np.concatenate([c for _, c in slabs]))
        counts, odds = np.empty(len(keys), np.int64), np.empty(len(codes))
        counts[np.argsort(keys % tk.U(buckets), kind="stable")] = np.concatenate([_numbers(b, np.int64) for b in right.column("counts").to_pylist()])
        odds[np.argsort(_gram_buckets(codes, buckets), kind="stable")] = np.concatenate([_numbers(b, np.float64) for b in right.column("odds").to_pylist()])
        end = counts[np.searchsorted(keys, tk.U(_END_KEY))]
        n_tokens, n_known, raw, score = [], [], [], []
        for _, first, h, code, begin in _slabs(left.column("x")):
            c, n = counts[np.searchsorted(keys, h)], np.diff(first)
            full = np.flatnonzero(n)

            def total(v, first=first, full=full):
                out = np.zeros(len(first) - 1)
                if len(full):
                    out[full] = np.add.reduceat(v.astype(float), first[:-1][full])
                return out

            n_tokens.append(n + 1)
            n_known.append((total(c > 0) + (end > 0)).astype(np.int64))
            raw.append(total(np.log10(c + 0.1)) + np.log10(end + 0.1))
            by = np.argsort(code)
            each = np.empty(len(code))
            each[by] = odds[np.searchsorted(codes, code[by])]
            score.append(np.add.reduceat(each, begin))
        put = lambda x, kind: pa.array(np.concatenate(x), kind)
        return pa.table(
            {
                "doc_id": left.column("doc_id"), "trained": left.column("train"), "n_tokens": put(n_tokens, pa.int64()),
                "n_known": put(n_known, pa.int64()), "raw": put(raw, pa.float64()), "score": put(score, pa.float64()),
            }
        )

    return run


def _distinct(column):
    for _, _, h, code, _ in _slabs(column):
        yield np.unique(h), np.unique(code)


def score_documents(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, trained, n_tokens, n_known, train_tokens, base_score,
    score. Rows where `learn` holds are learnt from; null there counts as false.

    Defined cases: null text is empty, one end; null ids and repeated rows stay and are learnt as often as
    they occur, in chunks by their place; equal texts have equal scores; texts of any length are scored whole; an
    empty table gives an empty one; with nothing to learn from all words are unknown and bytes
    equally likely; other columns are ignored. White space between words counts as one space."""
    spark = docs.sparkSession
    docs, place = placed(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    chunks = max(2 * spark.sparkContext.defaultParallelism, size // CHUNK_BYTES)
    buckets = max(2 * partitions(spark), size // 6 // BUCKET_WORDS)
    rows = docs.select(
        F.pmod(place, F.lit(chunks)).alias("chunk"),
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("x"),
        F.coalesce(learn, F.lit(False)).alias("train"),
    )
    packed = "bucket long, chunk long, words binary, word_counts binary, grams binary, gram_counts binary, low binary"
    sent = durable(rows.groupBy("chunk").applyInArrow(_gather(buckets), packed))
    pairs = sent.where("low is not null").select("low").mapInArrow(_low_rows, "pair long, n long")
    pairs = pairs.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most 2^16 rows
    low = spark.sparkContext.broadcast((pairs.column("pair").to_numpy().astype(np.uint64), pairs.column("n").to_numpy()))
    answers = durable(
        sent.where("bucket is not null")
        .drop("low")
        .groupBy("bucket")
        .applyInArrow(_answer(low), "chunk long, bucket long, counts binary, odds binary, tokens long, words long")
    )
    low.destroy()
    release(sent)
    told = answers.where("chunk is null").agg(F.sum("tokens").alias("n"), F.sum("words").alias("v")).first()
    replies = answers.where("chunk is not null").select("chunk", "bucket", "counts", "odds")
    schema = f"doc_id {kind}, trained boolean, n_tokens long, n_known long, raw double, score double"
    out = rows.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_score(buckets), schema)
    tokens, words = int(told.n or 0), int(told.v or 0)
    base = F.col("raw") - F.col("n_tokens") * F.log10(F.lit(tokens + 0.1 * (words + 1)))
    return out.select(
        "doc_id", "trained", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score"
    )
