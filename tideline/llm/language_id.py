"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's features are its byte 2-, 3- and 4-grams, lower-cased, hashed into BUCKETS; the text is the average of
their embeddings, and a linear layer with softmax gives language odds. Both layers are trained by
stochastic gradient descent in numpy. A fifth of the training rows calibrates (all, where fewer than 50 are there): a
temperature for the odds, and the margin between the two best languages' logits under which a prediction is
rejected, which a share of REJECT of that fifth's right ones lack. The margin is that of the averages as they are, which
texts of other scripts, code and noise leave small, while odds come out near one for them too.

Scale: the model is fitted on about TRAIN_ROWS rows for each language, or fewer where languages are so many that
these would pass FIT_ROWS in all, picked by hashed ids; of these all hashed counts meet in one executor's
task, and only the model reaches the driver. Prediction is one pass without a shuffle: embeddings times the
linear layer make a table of one row for each bucket, so a text costs a lookup for each byte and gram
size, whatever its length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import durable

BUCKETS, DIM, STEPS, BATCH, RATE = 1 << 15, 16, 2000, 32, 4.0
TRAIN_ROWS, FIT_ROWS, REJECT = 1500, 24_000, 0.002
GRAMS = (2, 3, 4)
UNKNOWN = "und"


def _grams(column):
    """(first row, bytes, offsets, for each gram size the buckets of all bytes' grams and row borders)."""
    for lo, body, offsets in tk.slabs(column, 1 << 18):
        b = tk._LOWER[body].astype(np.uint32)
        for n in GRAMS:
            code = np.full(max(0, len(b) - n + 1), n, np.uint32)
            for j in range(n):
                code = (code ^ b[j : len(b) - n + 1 + j]) * np.uint32(16777619)
            at = (code ^ (code >> np.uint32(15))) % np.uint32(BUCKETS)
            first = np.minimum(offsets[:-1], len(at))
            last = np.maximum(np.minimum(offsets[1:] - n + 1, len(at)), first)
            yield lo, n, at, first, last


def _row_sums(values, first, last):
    """Sums of values[first:last], row by row."""
    run = np.zeros((len(values) + 1, values.shape[1]))
    np.cumsum(values, axis=0, out=run[1:])
    return run[last] - run[first]


def _count(batches):
    """Arrow mapper: (text, lang, order) to hashed counts, whole texts."""
    for batch in batches:
        packed = []
        held = [[] for _ in range(batch.num_rows)]
        for lo, _, at, first, last in _grams(batch.column(0)):
            for r, (a, b) in enumerate(zip(first.tolist(), last.tolist())):
                held[lo + r].append(at[a:b])
        for parts in held:
            k, c = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint32), return_counts=True)
            packed.append(k.astype("<u2").tobytes() + c.astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(packed, pa.binary())], names=["lang", "h", "kc"])


def _margins(z):
    """How far each row's best logit is above its second best (above 0, of one language)."""
    z = np.sort(np.pad(z, ((0, 0), (0, int(z.shape[1] == 1)))), axis=1)
    return z[:, -1] - z[:, -2]


def fit(rows, seed=7):
    """rows: (lang, buckets, counts). Returns languages, the table of logits and biases, the
    temperature and the threshold."""
    rng = np.random.default_rng(seed)
    rows = [r for r in rows if len(r[1])]
    langs = sorted({r[0] for r in rows})
    if not langs:
        return [], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0
    y = np.array([langs.index(r[0]) for r in rows])
    share = [np.asarray(c, np.float32) / np.float32(np.sum(c)) for _, _, c in rows]
    keys = [np.asarray(k) for _, k, _ in rows]
    order = rng.permutation(len(rows))
    held = order[: len(rows) // 5] if len(rows) >= 50 else order
    train = order[len(rows) // 5 :] if len(rows) >= 50 else order
    E, W, bias = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, len(langs))), np.zeros(len(langs))

    def soft(z):
        z = np.exp(z - z.max(axis=-1, keepdims=True))
        return z / z.sum(axis=-1, keepdims=True)

    for step in range(STEPS):
        rate = RATE * (1 - step / STEPS)
        part = rng.choice(train, min(BATCH, len(train)), replace=False)
        h = np.stack([share[i] @ E[keys[i]] for i in part])
        g = soft(h @ W + bias)
        g[np.arange(len(part)), y[part]] -= 1
        g /= len(part)
        back = g @ W.T
        W -= rate * (h.T @ g)
        bias -= 0.1 * rate * g.sum(axis=0)
        for row, i in enumerate(part):
            E[keys[i]] -= rate * 8 * share[i][:, None] * back[row]
    table = E @ W
    z = np.stack([share[i] @ table[keys[i]] for i in held]) + bias
    right = y[held]
    # one temperature that makes the held rows likeliest
    loss = lambda t: -np.log(soft(z / t)[np.arange(len(held)), right] + 1e-12).mean()
    temperature = min(np.geomspace(0.002, 20, 93), key=loss)
    good = np.sort(_margins(z)[z.argmax(axis=1) == right])
    threshold = float(good[int(REJECT * len(good))]) if len(good) else 0.0
    return langs, table, bias, float(temperature), threshold


def _judge(model, column):
    """Language, score and acceptance of each text of an Arrow column."""
    import regex

    langs, table, bias, temperature, threshold = model
    letter, n = regex.compile(r"\p{L}"), len(column)
    known = np.array([bool(t and letter.search(t)) for t in column.to_pylist()], bool)
    if not langs:
        return np.array([UNKNOWN] * n, object), np.zeros(n), np.zeros(n, bool)
    total, grams = np.zeros((n, len(langs))), np.zeros(n)
    for lo, _, at, first, last in _grams(column):
        hi = lo + len(first)
        grams[lo:hi] += last - first
        total[lo:hi] += _row_sums(table[at], first, last)
    z = total / np.maximum(grams, 1)[:, None] + bias
    clear = _margins(z) >= threshold
    z = np.exp((z - z.max(axis=1, keepdims=True)) / temperature)
    p = z / z.sum(axis=1, keepdims=True)
    score = np.where(known, np.clip(p.max(axis=1), 0, 1), 0.0)
    return np.where(known, np.array(langs, object)[p.argmax(axis=1)], UNKNOWN), score, known & clear


def _predictor(model):
    def run(batches):
        for batch in batches:
            names, score, accepted = _judge(model, batch.column(0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(names, pa.string()), pa.array(score), pa.array(accepted)],
                names=[*batch.schema.names[1:], "lang_pred", "score", "accepted"],
            )

    return run


def _keeper(model, place):
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_judge(model, batch.column(place))[2], pa.bool_()))

    return run


def _fit(table):
    """All counts to one row with the model, the same whatever the order of the rows."""
    langs, blobs, parts = table.column("lang").to_pylist(), table.column("kc"), []
    for i in sorted(range(len(langs)), key=list(zip(langs, table.column("h").to_pylist())).__getitem__):
        raw = blobs[i].as_buffer()  # read in place
        n = raw.size // 6
        parts.append((langs[i], np.frombuffer(raw, "<u2", n), np.frombuffer(raw, "<f4", n, 2 * n)))
    names, logits, bias, temperature, threshold = fit(parts)
    return pa.table(
        {
            "langs": pa.array([names], pa.list_(pa.string())),
            "logits": pa.array([logits.tobytes()], pa.binary()),
            "bias": pa.array([bias.tobytes()], pa.binary()),
            "temperature": pa.array([temperature], pa.float64()),
            "threshold": pa.array([threshold], pa.float64()),
        }
    )


def train_language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
    """The model, from rows with text and a language: all languages, and about TRAIN_ROWS rows
    for each, or an equal share of FIT_ROWS if that is less. Rows are picked by a hash of the id, null ids by one of the text, so
    repeated rows are picked together; rows without text or language teach nothing; an empty table gives a model that rejects all."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    pick = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.col(text_col)), F.lit("fit"))
    order = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    slim = rows.select(F.col(text_col).alias("x"), F.col(lang_col).alias("lang"), order.alias("h"), pick.alias("pick"))
    sizes = durable(slim.groupBy("lang").agg(F.count("*").alias("n")))
    each = min(TRAIN_ROWS, max(1, FIT_ROWS // max(1, sizes.count())))
    # about `each` rows of a language, by a hash of the id; a language with no more has them all
    bound = (F.lit(2.0 * each) / F.col("n") - 1) * 2.0**63
    odds = sizes.select("lang", F.when(F.col("n") > each, bound.cast("long")).alias("bound"))
    sample = slim.join(F.broadcast(odds), "lang").where("bound is null or pick <= bound").select("x", "lang", "h")
    counts = sample.mapInArrow(_count, "lang string, h long, kc binary")
    out = "langs array<string>, logits binary, bias binary, temperature double, threshold double"
    got = counts.groupBy(F.lit(0).alias("all")).applyInArrow(_fit, out).first()
    if got is None:
        return fit([])
    logits = np.frombuffer(got.logits).reshape(BUCKETS, len(got.langs))
    return got.langs, logits, np.frombuffer(got.bias), got.temperature, got.threshold


def identify_languages(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, lang_pred, score, accepted.

    lang_pred is 'und' with score 0, and rejected, if the text is null, has no letter, or nothing was
    learned. Null ids and repeated rows stay, equal texts get equal results; of equally likely languages the first by name
    is predicted; texts of any length are read whole, in slabs, a single one at about 60 times its bytes; an empty table gives
    an empty one; other columns are ignored, and language, source and id are no inputs of a prediction."""
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(text_col).alias("x"), F.col(id_col).alias("doc_id"))
    return out.mapInArrow(_predictor(model), f"doc_id {kind}, lang_pred string, score double, accepted boolean")


def keep_identified(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text the model accepts; cases as in identify_languages."""
    return docs.mapInArrow(_keeper(model, docs.columns.index(text_col)), docs.schema)
