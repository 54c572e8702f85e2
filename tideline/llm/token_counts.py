"""Token counts by a digest cache.

A text's digest is SHA-256 over its content in the tokenizer's normal form; with the digest of
the tokenizer's file (its version) it keys a table of counts. Only digests that the cache lacks
are encoded, once each however many rows have them, and the new counts are appended to the cache.

Scale: digests are computed where the text is read; rows travel as 40 bytes, and text moves only
for the one row that stands for each miss. The cache is a Parquet table, joined, never broadcast by
force; counts are read from it alone. Encoding works on a task's distinct pieces between white space, which no token spans."""

from __future__ import annotations

import hashlib
import sys
import types

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import durable, placed, scratch

#: Pieces whose counts a worker remembers before they age (those used again stay), twice; texts in hand at a time.
REMEMBERED, STEP = 1 << 19, 64
CACHE = "tokenizer string, digest binary, n_tokens long"


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _piecewise(path):
    """True if a tokenizer's tokens never span white space and white space itself gives none: its
    pre-tokenizer keeps only matches of a pattern without white space, and nothing is added."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return (
        first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and bool(first.get("invert"))
        and r"[^\s\p{L}\p{N}]+" in str(first.get("pattern"))
        and not any(c.isspace() for t in spec.get("added_tokens", []) for c in t["content"])
    )


def _encoder(path, version, pieces):
    """Arrow mapper: (digest, text) to (digest, n_tokens)."""

    def load():
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]

    def run(batches):
        # Workers serve many tasks: the tokenizer and the pieces stay for the next one.
        kept = sys.modules.setdefault("tideline_worker", types.ModuleType("tideline_worker")).__dict__
        if kept.get("version") != version:
            kept.update(version=version, count=load(), known={}, aged={})
        count, known, aged = kept["count"], kept["known"], kept["aged"]
        for batch in batches:
            n = []
            for lo in range(0, batch.num_rows, STEP):
                texts = batch.column(1).slice(lo, STEP).fill_null("").to_pylist()
                if not pieces:
                    n += count(texts)
                    continue
                split = [t.encode().split() for t in texts]
                missing = {w for words in split for w in words if w not in known}
                known.update((w, aged[w]) for w in missing if w in aged)
                new = [w for w in missing if w not in aged]
                for at in range(0, len(new), 4096):
                    part = new[at : at + 4096]
                    known.update(zip(part, count([w.decode() for w in part])))
                n += [sum(map(known.__getitem__, words)) for words in split]
                if len(known) > REMEMBERED:
                    aged, known = known, {}
                    kept.update(known=known, aged=aged)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return run


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    cache_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes (UTF-8), n_tokens, digest.

    Counts are the library's, without added special tokens; .json files load in tokenizers, .model
    files in sentencepiece. The cache is a table of tokenizer (digest of its file), digest and n_tokens at cache_path, which
    lasts from call to call; without a path it is one of this call's own, in the shared folder. Defined cases: null text
    counts as empty (0 bytes); null ids and repeated rows stay, one result each; a digest that several writers have
    appended counts once; texts of any length are encoded whole, in a task's memory; an empty table gives an empty one;
    other columns are ignored."""
    spark = docs.sparkSession
    docs, place = placed(docs)
    version = file_digest(tokenizer_path)
    pieces = tokenizer_path.endswith(".json") and _piecewise(tokenizer_path)
    if cache_path is None:
        cache_path = scratch(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # where white space gives no tokens, its amount is no part of the content
    normal = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")) if pieces else text
    digest = F.unhex(F.sha2(normal.cast("binary"), 256))
    rows = durable(docs.select(F.col(id_col).alias("doc_id"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), place.alias("p")))
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache_path)  # the first use makes the table
    cached = spark.read.schema(CACHE).parquet(cache_path).where(F.col("tokenizer") == version).select("digest")
    # one row stands for each miss, by its place: copies of one text meet in no single task
    misses = rows.groupBy("digest").agg(F.min("p").alias("p")).join(cached, "digest", "left_anti")
    texts = docs.select(place.alias("p"), normal.alias("x"))
    one = texts.join(misses.hint("shuffle_hash"), "p").select("digest", "x")
    fresh = one.mapInArrow(_encoder(tokenizer_path, version, pieces), "digest binary, n_tokens long")
    fresh.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    counts = spark.read.schema(CACHE).parquet(cache_path).where(F.col("tokenizer") == version)
    counts = counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", "digest")
