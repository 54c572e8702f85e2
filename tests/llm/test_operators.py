"""Corpus operators against brute force, and their defined results in odd cases."""

import collections
import hashlib
import math
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import LOWER, WORD, brute_components, brute_mix, leaks_of
from pyspark.sql import functions as F

from tideline.llm import language_id
from tideline.llm import queries as q
from tideline.llm.decontamination import decontaminate
from tideline.llm.language_id import identify_languages, train_language_id
from tideline.llm.license_scan import scan_licenses
from tideline.llm.license_texts import LICENSES
from tideline.llm.lm_scoring import DISCOUNT, ORDER, score_documents
from tideline.llm.minhash import near_duplicates
from tideline.llm.mixing import mix_sources
from tideline.llm.quality_rules import DELTA, LIMIT, RULES, STEPS, apply_rules, choose_cutoffs, upper_bound
from tideline.llm.shared import as_read, row_key
from tideline.llm.sharding import shard_by_bytes
from tideline.llm.substring_dedup import substring_dedup
from tideline.llm.token_counts import token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, kept string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").cache()


@pytest.fixture(scope="module")
def local(docs):
    return {r.doc_id: r for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    long_text = " ".join(f"w{i % 977} Ünï{i}" for i in range(20000))
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [
        (1, "a b c " + passage, "en", "s1"), (2, passage, "en", "s1"), (2, passage, "en", "s1"), (3, None, None, None),
        (None, passage + " tail", "en", None), (None, None, None, None), (4, "", "en", "s2"), (5, " \t\n ", None, "s2"),
        (6, long_text, "en", "s1"), (7, long_text, "en", "s1"), (8, "one two", "fr", "s2"), (8, "other words here", "fr", "s2"),
    ]
    return spark.createDataFrame([(*r, None, "x", "y") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substring_dedup_odd(odd, empty):
    out = substring_dedup(odd)
    got = rows_of(out.select("doc_id", "n_words", "n_removed"))
    assert got == sorted(
        [(1, 33, 0), (2, 30, 30), (2, 30, 30), (3, 0, 0), (None, 31, 30), (None, 0, 0), (4, 0, 0), (5, 0, 0), (6, 40000, 0), (7, 40000, 40000), (8, 2, 0), (8, 3, 0)],
        key=lambda r: tuple((x is None, str(x)) for x in r),
    )
    spans = {tuple(r.spans[0]) for r in out.where("doc_id is null and n_words > 0").collect()}
    assert spans == {(0, 29)}
    assert substring_dedup(empty).count() == 0


def test_substring_dedup_null_ids_of_like_checksum(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    long = "head of it " + passage + " tail"
    low = lambda t: zlib.crc32(t.encode()) & 0xFFFF
    other = lambda j: " ".join(f"u{j}x{i}" for i in range(20))
    short = next(t for t in map(other, range(10**6)) if low(t) == low(long))
    frame = spark.createDataFrame([(1, passage), (None, long), (None, short)], "doc_id long, text string")
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(frame).drop("spans").collect()}
    assert got == {(1, 30, 0, passage), (None, 34, 30, "head of it tail"), (None, 20, 0, short)}


def test_substring_dedup_repeated_ids(spark):
    """Many rows with null, equal and other ids that share passages, against plain Python, spans too."""
    rng = np.random.default_rng(8)
    passages = [[f"p{k}_{i}" for i in range(int(n))] for k, n in enumerate([13, 14, 30, 60, 12])]
    rows = []
    for k in range(400):
        words = [f"u{k}_{i}" for i in range(int(rng.integers(0, 20)))]
        for j in rng.integers(0, 5, 2):
            cut = passages[j][int(rng.integers(0, 3)) :]
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = cut
        rows.append((None if k % 3 == 0 else int(rng.integers(0, 60)), " ".join(words)))
    rows += rows[:50] + [(None, rows[7][1])] * 30
    least = {}
    ids = lambda i: (1 << 63) - 1 if i is None else i
    for i, t in rows:
        w = t.split()
        for a in range(len(w) - 12):
            key = tuple(w[a : a + 13])
            least[key] = min(ids(i), least.get(key, ids(i)))
    want = collections.Counter()
    for i, t in rows:
        w, gone = t.split(), set()
        for a in range(len(w) - 12):
            if least[tuple(w[a : a + 13])] < ids(i):
                gone |= set(range(a, a + 13))
        spans = tuple((p, q) for p, q in zip(sorted(x for x in gone if x - 1 not in gone), sorted(x for x in gone if x + 1 not in gone)))
        want[i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone), spans] += 1
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text, tuple(map(tuple, r.spans))) for r in substring_dedup(frame).collect())
    assert got == want


def test_token_counts(spark, docs, local, odd, empty, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    want = {i: len(model.encode(r.text, add_special_tokens=False).ids) for i, r in local.items()}
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, path).collect()} == want
    tricky = ["<|endoftext|>a<|startoftext|> b", "don't we'll  I am x\x1cy\x85z", "é ́ İ ΣΣ 12345 !?# a​b", "가 \r\n\x0b x", "ﬁ Å"]
    frame = spark.createDataFrame(list(enumerate(tricky)), "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.n_bytes) for r in token_counts(frame, path).collect()}
    assert got == {i: (len(model.encode(t, add_special_tokens=False).ids), len(t.encode())) for i, t in enumerate(tricky)}
    cache = str(tmp_path / "cache")
    first = rows_of(token_counts(odd, path, cache).select("doc_id", "n_bytes", "n_tokens"))
    size = spark.read.parquet(cache).count()
    assert size == spark.read.parquet(cache).select("digest").distinct().count()
    assert rows_of(token_counts(odd, path, cache).select("doc_id", "n_bytes", "n_tokens")) == first
    assert spark.read.parquet(cache).count() == size and len(first) == odd.count()
    assert token_counts(empty, path).count() == 0
    # warm: stored counts are believed, only misses are encoded and appended; other tokenizers' rows aren't seen
    some = docs.where("doc_id < 40").select("doc_id", "text")
    token_counts(some.where("doc_id < 20"), path, cache)
    wrong = spark.read.parquet(cache).withColumn("n_tokens", F.col("n_tokens") + 1000)
    other = str(tmp_path / "other")
    wrong.unionByName(wrong.limit(5)).write.parquet(other)
    size = wrong.select("digest").distinct().count()
    got = {r.doc_id: r.n_tokens for r in token_counts(some, path, other).collect()}
    assert got == {i: want[i] + 1000 * (i < 20 or local[i].text in {local[j].text for j in range(20)}) for i in got} and len(got) == 40
    assert spark.read.parquet(other).select("digest").distinct().count() == size + len({local[i].text for i in range(20, 40)} - {local[j].text for j in range(20)})
    piece = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece)
    assert {r.doc_id: r.n_tokens for r in token_counts(some, piece, other).collect()} == {i: len(model.encode(local[i].text or "")) for i in got}
    got = {r.doc_id: r.n_tokens for r in token_counts(frame, piece).collect()}
    assert got == {i: len(model.encode(t)) for i, t in enumerate(tricky)}


def test_decontamination(spark, docs, local, data, odd, empty):
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    found = {(r.doc_id, r.item_id, r.matched_words) for r in decontaminate(docs, bench).collect()}
    assert found == leaks_of([(i, r.text) for i, r in local.items()], [(r.item_id, r.text) for r in bench.collect()]) and found
    question = "Anna bought 12 red apples and 12 green pears for 5.50 dollars, then walked 3 km to the market."
    long_item = "The old mill by the river grinds wheat and barley all through the long winter. It holds 12 stones and 12 sieves for the miller to use."
    items = [(1, "So then " + question), (2, None), (3, "short one"), (4, "What weighs more than gold"), (5, "1 2 3 4 5 6 7 8 9 10"), (6, long_item), (7, "")]
    texts = [
        "Yesterday then Maria bought 7 red apples and 7 green pears for 9 dollars, then walked 40 km to the market. End.",
        "Yesterday then Maria bought 7 red apples and 8 green pears for 9 dollars, then walked 40 km to the market. End.",
        "He bought nothing at all and walked home to sleep for a while in the quiet of the evening.",
        "So then " + question,
        # a name of two words; equal values where the item's differ
        "Yesterday then Maria Lopez bought 9 red apples and 9 green pears for 9 dollars, then walked 9 km to the market. End.",
        # a verbatim run, then another value for one of two equal ones
        "x y. " + long_item.replace("12 sieves", "14 sieves"),
        # a word put in: neither side is long enough alone
        question.replace("and 12 green", "and exactly 12 green"),
        "they asked: what weighs more than gold? nobody knew", "short one", "a short one here", "set 1 2 3 4 5 6 7 8 9 10 end", "set 1 2 3 4 5 6 7 9 8 10 end", None, "", "#n=3 = _ # %",
        # whole items without their capitals, or all in capitals, and with other numbers
        ("so then " + question).lower(), "SEE: " + question.upper(), ("Then " + question).replace("12", "31").lower(), long_item.upper().replace("12 SIEVES", "14 SIEVES"),
    ]
    frame = spark.createDataFrame([(None if k == 3 else k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, t, "z") for k, t in items], "item_id long, text string, kept string")
    out = decontaminate(frame.unionByName(frame.where("doc_id = 0")), bench).collect()
    got = {(3 if r.doc_id is None else r.doc_id, r.item_id, r.matched_words) for r in out}
    assert got == leaks_of(enumerate(texts), items) and len(out) == len(got)
    assert {(i, k) for i, k, _ in got} == {(0, 1), (3, 1), (4, 1), (5, 6), (6, 1), (7, 4), (8, 3), (10, 5), (15, 1), (16, 1), (17, 1), (18, 6)}
    assert {r.doc_id for r in out if r.verbatim} == {None, 5, 6, 7, 8, 10, 15, 16, 18}
    assert decontaminate(odd, bench).count() == 0 and decontaminate(empty, bench).count() == 0
    assert decontaminate(frame, bench.limit(0)).count() == 0


def stream_of(words):
    """A text's bytes as the model sees them: beginnings, words with a space behind each, an end."""
    return [0xFE] * ORDER + [x for w in words for x in [*w.encode(), 0x20]] + [0xFF]


def brute_lm(texts, learn):
    """Unigram base and PPM by plain recursion."""
    words = {i: WORD.findall((t or "").translate(LOWER)) for i, t in texts.items()}
    counts = collections.Counter()
    grams = [collections.defaultdict(collections.Counter) for _ in range(ORDER + 1)]
    for i in learn:
        counts.update([*words[i], None])
        body = stream_of(words[i])
        for j in range(ORDER, len(body)):
            for k in range(ORDER + 1):
                grams[k][tuple(body[j - k : j])][body[j]] += 1
    n, v = sum(counts.values()), len(counts)

    def ppm(ctx, sym):
        p, banned = 1.0, set()
        for k in range(ORDER, -1, -1):
            seen = {s: c for s, c in grams[k].get(ctx[ORDER - k :], {}).items() if s not in banned}
            total = sum(seen.values())
            if not total:
                continue
            if sym in seen:
                return p * (seen[sym] - DISCOUNT) / total
            p *= DISCOUNT * len(seen) / total
            banned |= set(seen)
        return p / (256 - len(banned))

    out = {}
    for i, w in words.items():
        tokens = [*w, None]
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        body = stream_of(w)
        score = sum(math.log10(ppm(tuple(body[j - ORDER : j]), body[j])) for j in range(ORDER, len(body)))
        out[i] = (len(tokens), sum(counts[t] > 0 for t in tokens), n, base, score)
    return out


def test_lm_scoring(docs, local, odd, empty):
    part = docs.where("doc_id % 4 = 0")
    texts = {i: r.text for i, r in local.items() if i % 4 == 0}
    want = brute_lm(texts, [i for i in texts if zlib.crc32(str(i).encode()) % 10])
    got = score_documents(part, ~q.held_out(10, 0)).collect()
    assert len(got) == len(want)
    for r in got:
        n, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
    assert score_documents(odd, ~q.held_out(10, 0)).count() == odd.count()
    assert score_documents(empty, ~q.held_out(10, 0)).count() == 0
    nothing = score_documents(odd, F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens) for r in nothing} == {(0, 0)}


def test_lm_scoring_keeps_rare_contexts(spark):
    # 2.3 million contexts with a symbol, nearly all of them seen once
    rng = np.random.default_rng(5)
    words = rng.integers(97, 123, (150_000, 19), dtype=np.uint8)
    text = [x.tobytes().decode() for x in words]
    probe = [*text[:3], *text[70_000:70_003], "q" * 19, "é" * 3]
    rows = [(i, " ".join(text[i * 2500 : i * 2500 + 2500])) for i in range(60)] + [(60, " ".join(probe))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = score_documents(frame, F.col("doc_id") < 60).where("doc_id = 60").first()
    wide = np.array([stream_of(text[i * 2500 : i * 2500 + 2500]) for i in range(60)], np.uint8)
    seen = np.lib.stride_tricks.sliding_window_view(wide, ORDER + 1, axis=1).reshape(-1, ORDER + 1)

    def ppm(ctx, sym):
        p, banned = 1.0, set()
        for k in range(ORDER, -1, -1):
            part = seen
            for j in range(ORDER - 1, ORDER - 1 - k, -1):
                part = part[part[:, j] == ctx[j]]
            counts = {s: c for s, c in enumerate(np.bincount(part[:, -1]).tolist()) if c and s not in banned}
            total = sum(counts.values())
            if not total:
                continue
            if sym in counts:
                return p * (counts[sym] - DISCOUNT) / total
            p *= DISCOUNT * len(counts) / total
            banned |= set(counts)
        return p / (256 - len(banned))

    body = stream_of(probe)
    want = sum(math.log10(ppm(body[j - ORDER : j], body[j])) for j in range(ORDER, len(body)))
    assert got.score == pytest.approx(want, rel=1e-9)


def test_lm_scoring_beats_words(spark):
    """On texts that it hasn't learnt the model is clearly ahead of the word-unigram base."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = score_documents(docs, ~q.held_out(10, 0)).where("not trained")
    r = out.agg((F.sum("score") / F.sum("n_tokens")).alias("s"), (F.sum("base_score") / F.sum("n_tokens")).alias("b")).first()
    assert r.s > r.b + 0.15


def test_mixing(docs, local, odd, empty):
    out = mix_sources(docs).collect()
    sizes = {i: len(WORD.findall(r.text or "")) for i, r in local.items()}
    by = collections.Counter()
    for i, r in local.items():
        by[r.source] += sizes[i]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(by))}
    budget, target, left = 1.5 * sum(by.values()), dict.fromkeys(by, 0.0), set(by)
    while True:
        rest = budget - sum(target[s] for s in by if s not in left)
        share = {s: rest * weight[s] / sum(weight[t] for t in left) for s in left}
        over = {s for s in left if share[s] > 2 * by[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * by[s] for s in over}
        left -= over
    taken = collections.Counter()
    for r in out:
        assert r.size == sizes[r.doc_id] and r.taken in (0, r.size, 2 * r.size)
        assert r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    longest = max(sizes.values())
    assert all(abs(taken[s] - target[s]) <= longest for s in by) and sum(taken.values()) <= budget
    rows = [(i, r.text, r.source) for i, r in local.items()]
    times = collections.Counter()
    for r in out:
        times[bytes(r.row_key)] += r.taken // r.size if r.size else 0
    assert times == brute_mix(rows)
    # equal rows, with and without an id, and a null source
    many = [r for r in rows[:9] for _ in range(7)] + [(None, "one two three four", None)] * 50 + [(7, "x y", None), (None, None, "src1")]
    frame = odd.sparkSession.createDataFrame(many, "doc_id long, text string, source string").repartition(3)
    times = collections.Counter()
    for r in (got := mix_sources(frame).collect()):
        assert r.taken in (0, r.size, 2 * r.size)
        times[bytes(r.row_key)] += r.taken // r.size if r.size else 0
    assert len(got) == len(many) and times == brute_mix(many)
    first = rows_of(mix_sources(odd).select("doc_id", "size", "source_size", "target", "taken"))
    assert first == rows_of(mix_sources(odd.repartition(5)).select("doc_id", "size", "source_size", "target", "taken"))
    assert len(first) == odd.count() and mix_sources(empty).count() == 0


def test_language_id(spark, docs, odd, empty):
    model = train_language_id(docs.where(~q.held_out(4, 2)))
    out = identify_languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(q.held_out(4, 2))
    assert out.where("lang_pred = lang").count() >= 0.97 * out.count()
    assert out.where("not accepted").count() <= 0.02 * out.count()
    frame = spark.createDataFrame([(1, None), (2, "123 !!"), (3, ""), (4, "x")], "doc_id long, text string")
    got = {r.doc_id: r for r in identify_languages(frame, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[4].lang_pred != "und"
    assert not any(got[i].accepted or got[i].score for i in (1, 2, 3)) and all(0 <= r.score <= 1 for r in got.values())
    assert identify_languages(odd, model).count() == odd.count()
    none = train_language_id(empty)
    assert {r.lang_pred for r in identify_languages(odd, none).collect()} == {"und"}
    assert identify_languages(empty, model).count() == 0


def test_language_id_rejects(spark, docs):
    held = q.held_out(4, 2)
    model = train_language_id(docs.where(~held & (F.col("lang") != "de")))
    rng = np.random.default_rng(3)
    junk = [" ".join(rng.integers(97, 123, n, dtype=np.uint8).tobytes().decode() for n in rng.integers(2, 9, 200)) for _ in range(40)]
    frame = docs.where("lang = 'de'").select("doc_id", "text", F.lit("left out").alias("k"))
    frame = frame.union(docs.where(held & (F.col("lang") != "de")).select("doc_id", "text", F.lit("clean")))
    frame = frame.union(spark.createDataFrame([(-i, t, "junk") for i, t in enumerate(junk)], "doc_id long, text string, k string"))
    out = identify_languages(frame, model).join(frame.select("doc_id", "k"), "doc_id")
    share = {r.k: r.s for r in out.groupBy("k").agg(F.avg(F.col("accepted").cast("int")).alias("s")).collect()}
    assert share["clean"] >= 0.95 and share["left out"] <= 0.1 and share["junk"] == 0


def test_language_id_rejects_other_scripts(spark, docs):
    """At most one in fifty texts of other scripts, code and noise is accepted, while clean texts stay."""
    model = train_language_id(docs.where(~q.held_out(4, 2)))
    rng = np.random.default_rng(11)
    pick = lambda letters, n: "".join(rng.choice(list(letters), n))
    alphabets = ["абвгдежзийклмнопрстуфхцчшщыэюя ", "αβγδεζηθικλμνξοπρστυφχψω ", "的一是在不了有和人这中大为上个国我以要他", "abcdefghijklmnopqrstuvwxyz ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "{}();=<>!&|[] intforifelsereturn0123456789\n"]
    texts = [pick(a, int(n)) for a in alphabets for n in rng.integers(200, 900, 50)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = identify_languages(frame, model).collect()
    for k in range(len(alphabets)):
        assert sum(r.accepted for r in out if r.doc_id // 50 == k) <= 1
    # predictions, by plain Python
    langs, table, bias, temperature, threshold = model
    for r in identify_languages(docs.where("doc_id < 20"), model).join(docs.select("doc_id", "text"), "doc_id").collect():
        body = r.text.translate(LOWER).encode()
        z, n = np.zeros(len(langs)), 0
        for size in language_id.GRAMS:
            for a in range(len(body) - size + 1):
                h = size
                for x in body[a : a + size]:
                    h = (h ^ x) * 16777619 % 2**32
                z += table[(h ^ (h >> 15)) % language_id.BUCKETS]
                n += 1
        z = z / n + bias
        odds = np.exp((z - z.max()) / temperature)
        best = sorted(z)
        assert r.lang_pred == langs[int(z.argmax())] and r.score == pytest.approx(odds.max() / odds.sum(), rel=1e-6)
        assert r.accepted == (best[-1] - best[-2] >= threshold) or abs(best[-1] - best[-2] - threshold) < 1e-9


def test_language_id_learns_from_whole_texts(spark):
    text = " ".join(f"{i * 7919 % 100003:x}" for i in range(5000))
    batch = pa.RecordBatch.from_arrays([pa.array([text]), pa.array(["en"]), pa.array([1], pa.int64())], names=["x", "lang", "h"])
    blob = next(language_id._count([batch])).column("kc")[0].as_py()
    n = len(blob) // 6
    assert n > 1024 and np.frombuffer(blob, "<f4", n, 2 * n).sum() == sum(len(text) - k + 1 for k in language_id.GRAMS)
    # every language is learnt, however many
    rows = [(i, f"{i:03d}" * 20, f"l{i:03d}") for i in range(210)]
    model = train_language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model[0] == [r[2] for r in rows]


def test_quality_rules(spark, docs, local, data, odd, empty):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    for r in apply_rules(docs, labels).collect():
        text = local[r.doc_id].text or ""
        w = WORD.findall(text)
        runs = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + j for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r.base_failed and r.kept)
    lines = "a b\n\na b\n a b\na b \n\na b"
    frame = spark.createDataFrame([(1, lines, None), (2, "\nx\n\nx", "en"), (3, "x", "en"), (4, None, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.n_dup_lines, r.n_lines) for r in apply_rules(frame, labels).collect()}
    assert got == {1: (2, 5), 2: (1, 2), 3: (0, 1), 4: (0, 0)}
    assert apply_rules(odd, labels).count() == odd.count() and apply_rules(empty, labels.limit(0)).count() == 0
    # the bound is exact: probability delta of k or fewer
    for k, n, delta in ((0, 100, 0.05), (3, 50, 0.01), (10, 400, 0.001)):
        p = upper_bound(k, n, delta)
        assert sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) == pytest.approx(delta, rel=1e-6)
    assert choose_cutoffs([0, 0, 1, 50], 5000, 0.004, 0.002) == 3 and choose_cutoffs([0], 10, 0.004, 0.002) == 0


def test_quality_rules_verdict(spark):
    """kept and broken against a plain walk along the path, with exact binomial tails."""
    sf = "/root/testdata/sf0.1"
    quality = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        quality[r.doc_id] = min(r.quality, quality.get(r.doc_id, 1))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = apply_rules(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}

    def values(r):
        w = max(r.n_words, 1)
        return {"symbols": r.n_symbols / w, "dup_lines": r.n_dup_lines / max(r.n_lines, 1), "repeats": r.n_repeat_words / w, "long_words": r.word_chars / w, "short_words": -r.word_chars / w}

    def broken(r, step):
        return [k for k, v in values(r).items() if v > RULES[k][1][step]]

    strata = collections.defaultdict(list)
    for r in out:
        if quality.get(r.doc_id) == 1 and not r.base_failed:
            strata[lang[r.doc_id]].append(r)
    steps = {}
    for s, rows in strata.items():
        n, steps[s] = len(rows), -1
        for step in range(STEPS):
            k = sum(bool(broken(r, step)) for r in rows)
            # the bound is within LIMIT if k or fewer have probability DELTA at most there
            tail = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(LIMIT) + (n - j) * math.log1p(-LIMIT)) for j in range(k + 1))
            if tail > DELTA / len(strata):
                break
            steps[s] = step
    assert sum(k >= 0 for k in steps.values()) >= 3
    for r in out:
        want = broken(r, k) if (k := steps.get(lang[r.doc_id], -1)) >= 0 else []
        assert r.broken == ",".join(want) and r.kept == (not r.base_failed and not want)
    bad = [r for r in out if not r.base_failed and r.broken]
    print(steps, len(bad), sum(quality.get(r.doc_id) == 1 for r in bad), sum(quality.get(r.doc_id) == 0 for r in bad))
    assert bad


def test_license_scan(spark, odd, empty):
    mit = LICENSES[0][1]
    texts = [
        mit, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", ""), "MIT Licence\n(c) 1999 X\n" + mit.replace("\n", "\n\n   "), mit + " more", "words\nReleased under the MIT licence!\nReleased under the MIT License.",
        "Released under the MIT License.", None, "",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.license_id, r.n_notices, r.notices) for r in scan_licenses(frame).collect()}
    assert got == {0: ("MIT", 0, ""), 1: ("MIT", 0, ""), 2: ("MIT", 0, ""), 3: (None, 0, ""), 4: (None, 2, "MIT"), 5: ("MIT", 1, "MIT"), 6: (None, 0, ""), 7: (None, 0, "")}
    assert scan_licenses(odd).count() == odd.count() and scan_licenses(empty).count() == 0


def test_license_scan_of_wrapped_texts(spark):
    """Known texts at any width, under usual titles and copyright lines, by Spark and by SQL."""
    import textwrap

    titles = {"MIT": ["MIT License", "The MIT License (MIT)"], "ISC": ["ISC License"], "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ['BSD 3-Clause "New" or "Revised" License'], "Unlicense": [], "Zlib": ["zlib License"], "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003"]}
    heads = ["", "Copyright (c) 2019-2024, The Authors\n\n", "Copyright 2020 A. N. Other <a@b.c>\nCopyright (C) 1999 B.\nAll rights reserved.\n\n", "Copyright Jane Doe\n", "(c) 2021 Z\n", "// \u00a9 Someone\n"]
    rows = []
    for name, text in LICENSES:
        for width in range(40, 121):
            body = "\n".join(textwrap.fill(part, width) for part in text.split("\n"))
            for head in ["", heads[width % len(heads)]]:
                rows.append((name, head + body))
                rows += [(name, t + "\n\n" + head + body) for t in titles.get(name, [])]
    rows += [(None, "Copyright notice"), (None, "Copyright 2020 X"), (None, LICENSES[0][1] + " And more."), (None, "MIT License"), ("MIT", "Released under the MIT licence.")]
    frame = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in scan_licenses(frame).collect()}
    assert [k for k, (name, _) in enumerate(rows) if got[k].license_id != name] == []
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(k, t) for k, (_, t) in enumerate(rows) if k % 7 == 0])
    for doc_id, digest, license_id, n, notices in con.execute(q.op8_sql()).fetchall():
        r = got[doc_id]
        assert (r.text_digest, r.license_id, r.n_notices, r.notices) == (digest, license_id, n, notices)


def test_license_scan_of_dressed_texts(spark):
    """Headings, identifier lines, copyright lines that go on, curly quotes and dashes: by Spark and by SQL."""
    heads = [
        "# License\n\n", "LICENSE\n=======\n\nMIT License\n\n", "Copyright (c) 2021 Jane Doe, John Doe,\n  and contributors\n\n", "Copyright \u00a9 2020 A &\nB Company\n\n",
        "\u2014\u2014\u2014\n", "\u201cLicense\u201d\n",
    ]
    curly = lambda t: t.replace(' "', " \u201c").replace('("', "(\u201c").replace('"', "\u201d").replace("'", "\u2019")
    ids = {n: f"SPDX-License-Identifier: {n}\n\n" for n, _ in LICENSES}
    rows = [(n, h + f(t)) for n, t in LICENSES for h in [*heads, ids[n], "# License\n" + ids[n]] for f in (str, curly)]
    rows += [(None, "License"), (None, "# License\n\nCopyright (c) 2021 Jane,\nand others"), (None, "License " + LICENSES[0][1] + " \u00e9"), ("MIT", "SPDX-License-Identifier: MIT")]
    frame = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in scan_licenses(frame).collect()}
    assert [(name, rows[k][1][:40]) for k, (name, _) in enumerate(rows) if got[k].license_id != name] == []
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(k, t) for k, (_, t) in enumerate(rows)])
    for doc_id, digest, license_id, n, notices in con.execute(q.op8_sql()).fetchall():
        r = got[doc_id]
        assert (r.text_digest, r.license_id, r.n_notices, r.notices) == (digest, license_id, n, notices)


def test_license_digests(spark):
    """Long texts, where this machine has them, against the fixed digests."""
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    at = {f: f"/usr/share/common-licenses/{f}" for f in names}
    have = {f: p for f, p in at.items() if os.path.exists(p)}
    if not have:
        pytest.skip("no licence texts on this machine")
    rows = [(names[f], open(p, encoding="utf-8").read()) for f, p in have.items()]
    frame = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    assert {r.doc_id: r.license_id for r in scan_licenses(frame).collect()} == {k: n for k, (n, _) in enumerate(rows)}


def test_near_duplicates(docs, local, odd, empty):
    ids = sorted(local)
    want = brute_components([local[i].text for i in ids])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert got == {i: (n, ids[c], c == k) for k, (i, (n, c)) in enumerate(zip(ids, want))}
    got = rows_of(near_duplicates(odd).select("doc_id", "component_id", "kept"))
    want = [(1, 1, True), (2, 1, False), (2, 1, False), (3, 3, True), (None, 1, False), (None, None, True), (4, 4, True), (5, 5, True), (6, 6, True), (7, 6, False), (8, 8, True), (8, 8, True)]
    assert got == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))
    assert near_duplicates(empty).count() == 0


def test_near_duplicates_dense_groups(spark):
    """Groups whose members lie on both sides of the threshold, cut and lengthened too, some without ids."""
    rng = np.random.default_rng(5)
    texts = []
    for base in range(3):
        words = [f"w{base}_{i}" for i in range(100)]
        for _ in range(90):
            t = list(words[: rng.integers(70, 101)])
            for j in rng.integers(0, len(t), rng.integers(0, 6)):
                t[j] = f"x{rng.integers(1 << 40)}" if rng.random() < 0.7 else f"y{j % 7}"
            texts.append(" ".join(t + [f"z{rng.integers(1 << 40)}"] * int(rng.integers(0, 4))))
    texts += [texts[5]] * 40
    want = brute_components(texts)
    ids = [None if k % 5 == 4 else k for k in range(len(texts))]
    rows = {(ids[k], texts[k]): c for k, (_, c) in enumerate(want)}
    first = collections.defaultdict(list)
    for (i, _), c in rows.items():
        first[c].append(i)
    name = {c: min((i for i in g if i is not None), default=None) for c, g in first.items()}
    frame = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(4)
    got = near_duplicates(frame).join(frame.select(row_key("doc_id", "text").alias("row_key"), "text").distinct(), "row_key").collect()
    assert len(got) == len(texts)
    keys = collections.defaultdict(set)
    for r in got:
        c = rows[(r.doc_id, r.text)]
        keys[c].add(r.component_key)
        assert r.component_id == name[c]
        if name[c] is not None:
            assert r.kept == (r.doc_id == name[c])
    assert all(len(k) == 1 for k in keys.values()) and len({*map(min, keys.values())}) == len(keys)
    alone = {c for c in keys if name[c] is None}
    assert {c for c in alone if any(r.kept for r in got if rows[(r.doc_id, r.text)] == c)} == alone


def test_sharding(spark, docs, local, odd, empty):
    out = shard_by_bytes(docs).collect()
    total, by = sum(r.size for r in out), collections.defaultdict(list)
    for r in out:
        text = (local[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32) == (len(text) + 8, zlib.crc32(text))
        by[r.shard].append(r)
    assert len(out) == len(local) and set(by) <= set(range(24))
    longest = max(r.size for r in out)
    for part in by.values():
        assert abs(sum(r.size for r in part) - total / 24) <= longest + total / 24 / 50
        assert sorted(r.slot for r in part) == list(range(len(part)))
    # equal texts lie together
    where = collections.defaultdict(set)
    for r in out:
        where[local[r.doc_id].text].add(r.shard)
    assert all(max(s) - min(s) == len(s) - 1 for s in where.values())
    # every row's place, by plain Python
    rows = sorted((hashlib.md5((r.text or "").encode()).hexdigest(), i, len((r.text or "").encode()) + 8) for i, r in local.items())
    groups, start, where = collections.Counter(), 0, {}
    for h, _, size in rows:
        groups[h] += size
    for h, i, size in rows:
        where.setdefault(h, start)
        middle = where[h] + groups[h] / 2 if groups[h] <= total / 24 / 50 else start + size / 2
        where[i] = min(23, math.floor(middle * 24 / total))
        start += size
    slots = collections.Counter()
    for _, i, _ in rows:
        shard = where[i]
        where[i] = (shard, slots[shard])
        slots[shard] += 1
    assert {r.doc_id: (r.shard, r.slot) for r in out} == {i: where[i] for i in local}
    # a third of all rows are equal, ids too
    same = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    sums = [r.s for r in shard_by_bytes(same).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sums) == 24 and max(sums) - min(sums) <= 80
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    sums = [r.s for r in shard_by_bytes(hot).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sums) == 24 and max(sums) - min(sums) <= 80
    got = shard_by_bytes(odd).collect()
    assert len(got) == odd.count() and shard_by_bytes(empty).count() == 0


def test_kept_digest(odd):
    r = substring_dedup(odd).where("doc_id = 8 and n_words = 2").first()
    assert hashlib.sha256(r.kept_text.encode()).hexdigest() == hashlib.sha256(b"one two").hexdigest()


def everything(spark, data):
    """Every operator as a function of documents."""
    import public_tokenizers

    bench, labels = spark.read.parquet(f"{data}/benchmark.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    path = public_tokenizers.path("word_bpe_49k.json")
    model = train_language_id(spark.read.parquet(f"{data}/documents.parquet"))
    return {
        "op1": substring_dedup, "op2": lambda d: token_counts(d, path), "op3": lambda d: decontaminate(d, bench).drop("row_key"),
        "op4": lambda d: score_documents(d, ~q.held_out(10, 0)), "op5": mix_sources, "op6": lambda d: identify_languages(d, model),
        "op7": lambda d: apply_rules(d, labels), "op8": scan_licenses, "op9": near_duplicates, "op10": shard_by_bytes,
    }


def test_columns_of_any_name(spark, data, odd):
    """Extra columns, named like those that operators make or use inside, change nothing, null ids and repeated rows included."""
    names = (
        "i j k n u v t x h g b c p w r s m a d at y ws iv dv row key size place copy copies chunk slice digest range start end digests "
        "stratum base_failed broken score accepted lang_pred license_id notices text_digest n_tokens n_bytes train trained raw bucket "
        "taken target source_size row_key component_key component_id n_shingles bands sig ci di least least2 item group runs cover need words "
        "item_id matched_words verbatim slot text_crc32 block_ _metadata anchor gone spans kept_text tokenizer budget weight finish"
    ).split()
    more = odd.select("*", *[F.lit(7).alias(c) for c in names])
    for op, fn in everything(spark, data).items():
        assert rows_of(fn(more)) == rows_of(fn(odd)), op


def test_rows_of_derived_frames_have_their_own_places(spark, data, docs):
    """Explode, join, union and sample repeat or choose rows of a file; results are those of the rows written out."""
    import public_tokenizers

    read = spark.read.parquet(f"{data}/documents.parquet").where("doc_id < 60")
    path = public_tokenizers.path("word_bpe_49k.json")
    frames = {  # of each kind of plan; op9 on one
        "explode": read.withColumn("text", F.explode(F.split("text", "\n"))),
        "join": read.join(spark.range(2).withColumnRenamed("id", "twice")),
        "union": read.unionByName(read),
        "sample": read.sample(True, 2.0, seed=3),
        "plain": read.where("n_chars > 40").withColumn("text", F.upper("text")),
    }
    for name, frame in frames.items():
        local = spark.createDataFrame(frame.collect(), frame.schema)
        assert rows_of(token_counts(frame, path)) == rows_of(token_counts(local, path)), name
        if name == "explode":
            kept = [near_duplicates(d).select("doc_id", "n_shingles", "component_id", "kept") for d in (frame, local)]
            assert rows_of(kept[0]) == rows_of(kept[1])
    assert as_read(frames["plain"]) is frames["plain"] and all(as_read(f) is not f for k, f in frames.items() if k != "plain")


def test_odd_rows_have_the_defined_values(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    learnt = [k for k, (i, _) in enumerate(rows) if zlib.crc32(str("" if i is None else i).encode()) % 10]
    want = brute_lm({k: t for k, (_, t) in enumerate(rows)}, learnt)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens), r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in score_documents(odd, ~q.held_out(10, 0)).collect())
    assert got == sorted(((i is None, i or 0, want[k][0]), want[k][1], want[k][2], round(want[k][3], 6), round(want[k][4], 6)) for k, (i, _) in enumerate(rows))
    assert {(r.license_id, r.n_notices, r.notices) for r in scan_licenses(odd).collect()} == {(None, 0, "")}
    empty_digest = hashlib.sha256(b"").hexdigest()
    assert {r.doc_id for r in scan_licenses(odd).where(F.col("text_digest") == empty_digest).collect()} == {3, None, 4, 5}
    got = rows_of(apply_rules(odd, spark.createDataFrame([(6, 1), (6, 0)], "doc_id long, quality int")).select("doc_id", "n_words", "n_lines", "base_failed", "kept"))
    count = lambda t: len(WORD.findall(t or ""))
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert got == sorted(((i, count(t), int(count(t) > 0), count(t) < 50, count(t) >= 50) for i, t in rows), key=key)
    # places: in the order of (digest, id), cut at equal bytes, equal texts together where small
    sized = sorted((hashlib.md5((t or "").encode()).hexdigest(), (1 << 63) - 1 if i is None else i, len((t or "").encode()) + 8) for i, t in rows)
    total, start, want = sum(s for _, _, s in sized), 0, []
    groups = collections.Counter()
    for h, _, s in sized:
        groups[h] += s
    first = {}
    for h, i, s in sized:
        first.setdefault(h, start)
        middle = first[h] + groups[h] / 2 if groups[h] <= total / 3 / 50 else start + s / 2
        want.append((i, s, min(2, math.floor(middle * 3 / total))))
        start += s
    got = [((1 << 63) - 1 if r.doc_id is None else r.doc_id, r.size, r.shard) for r in shard_by_bytes(odd, shards=3).collect()]
    assert sorted(got) == sorted(want)
