"""Filter audit, spelling variants and SimHash groups against brute force, and their defined results in odd cases."""

import collections
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from brute import LOWER, WORD
from pyspark.sql import functions as F

from tideline.llm import queries as q
from tideline.llm import simhash, spelling
from tideline.llm.filter_audit import audit_filters, document_flags, replay_orders
from tideline.llm.simhash import near_fingerprints, simhash_duplicates
from tideline.llm.spelling import Automaton, corpus_words, crc32_spans, near_words, spelling_variants

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = "part A B C D E fails first at bit bits number step kept good toxic i x f u v root word n near near_n form digest least simhash slice block hot asks chunk _metadata".split()


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    long_text = " ".join(f"w{i % 977} Ünï{i}" for i in range(20000))
    rows = [
        (1, "Spelled spelled SPELLED spelled spelled speled spellled", "en"), (2, "same text", "en"), (2, "same text", "en"), (3, None, None),
        (None, "same text", "en"), (None, None, None), (4, "", ""), (5, " \t\n ", None), (6, long_text, "en"), (7, long_text, "en"),
        (8, "CAPITALS & SIGNS", "fr"), (8, "other words here", "fr"), (9, "one two three", "xx"), (10, "é" * 300 + " naïve", "fr"),
    ]
    return spark.createDataFrame([(*r, "s", 0) for r in rows], SCHEMA)


def local(df):
    return [(r.doc_id, r.text, r.lang) for r in df.select("doc_id", "text", "lang").collect()]


def flags_of(rows):
    first = {}
    for i, t, _ in rows:
        first[t or ""] = min(first.get(t or "", 1 << 63), (1 << 63) - 1 if i is None else i)
    out = []
    for i, t, lang in rows:
        t = t or ""
        w = WORD.findall(t)
        at = (1 << 63) - 1 if i is None else i
        out.append((i, lang or "", [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), at > first[t]]))
    return out


def brute_audit(flags, labels):
    """Every order, one document and one step after the other."""
    parts = {p for _, p, _ in flags}
    got = {(p, "".join(o), k + 1): collections.Counter() for p in parts for o in itertools.permutations("ABCDE") for k in range(5)}
    for i, p, f in flags:
        good, toxic = labels.get(i, (False, False)) if i is not None else (False, False)
        for o in itertools.permutations(range(5)):
            gone = False
            for k, c in enumerate(o):
                row = got[p, "".join("ABCDE"[x] for x in o), k + 1]
                row["unique_fails"] += f[c] and sum(f) == 1
                row["redundant"] += f[c] and gone
                row["removed"] += f[c] and not gone
                row["good_lost"] += f[c] and not gone and good
                row["toxic_lost"] += f[c] and not gone and toxic
                gone |= f[c]
                row["kept"] += not gone
    shapley = collections.Counter()
    for (p, o, k), row in got.items():
        shapley[p, o[k - 1]] += row["removed"]
    return {key: tuple(row[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")) + (shapley[key[0], key[1][key[2] - 1]],) for key, row in got.items()}


def audited(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): tuple(r[c] for c in names) for r in rows}
    assert len(out) == len(rows)
    return out


def test_filter_audit(spark, data, docs, odd):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    known = collections.defaultdict(lambda: (False, False))
    for r in labels.collect():
        known[r.doc_id] = (known[r.doc_id][0] or r.quality == 1, known[r.doc_id][1] or r.toxic == 1)
    assert audited(q.op11_filter_audit(spark, data)) == brute_audit(flags_of(local(docs)), known)
    # odd rows; several labels of one document, null ones and those of nothing
    marks = spark.createDataFrame([(2, 1, 0), (2, 0, 1), (8, None, None), (8, 1, None), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    more = odd.select("*", *[F.lit(7).alias(c) for c in NAMES])
    want = brute_audit(flags_of(local(odd)), {2: (True, True), 8: (True, False)})
    assert audited(audit_filters(odd, marks)) == audited(audit_filters(more, marks)) == want
    key = lambda r: (r[0] is None, str(r))
    got = [(r.doc_id, r.part, [r.A, r.B, r.C, r.D, r.E]) for r in document_flags(odd).collect()]
    assert sorted(got, key=key) == sorted(flags_of(local(odd)), key=key)
    assert audit_filters(odd.limit(0), marks).count() == 0
    assert audited(audit_filters(odd, marks.limit(0))) == brute_audit(flags_of(local(odd)), {})
    two = replay_orders(odd.select(F.lit("p").alias("part"), F.lit(True).alias("one"), F.lit(None).cast("boolean").alias("two")), ("one", "two"))
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.redundant) for r in two.collect()} == {
        ("onetwo", 1): (0, 14, 0), ("onetwo", 2): (0, 0, 0), ("twoone", 1): (14, 0, 0), ("twoone", 2): (0, 14, 0)}
    with pytest.raises(ValueError):
        replay_orders(odd, tuple("ABCDEFG"))


def brute_words(rows):
    n = collections.Counter()
    for i, t, _ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def is_near(a, b):
    """One letter inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, c in enumerate(a) if c != b[k]), len(a))
    return a[k:] == b[k + 1 :] or a[k + 1 :] == b[k + 1 :] and len(a) == len(b)


def brute_variants(n):
    """By all pairs of like letters and lengths."""
    bags, near = collections.defaultdict(list), collections.defaultdict(set)
    for w in n:  # words that differ in one edit agree in the first or the last two letters
        for bag in ((0, w[:2]), (1, w[-2:])):
            bags[bag].append(w)
    for bag in bags.values():
        for a, b in itertools.combinations(bag, 2):
            if abs(len(a) - len(b)) < 2 and is_near(a, b):
                near[a].add(b)
                near[b].add(a)
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: v for w, v in best.items() if n[v] >= 5 * n[w]}
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out


def variants(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_spelling_variants(spark, data, docs, odd):
    want = brute_variants(brute_words(local(docs)))
    assert variants(q.op12_spelling_variants(spark, data)) == want and any(f for f, *_ in want.values())
    more = odd.select("*", *[F.lit(7).alias(c) for c in NAMES])
    assert variants(spelling_variants(odd)) == variants(spelling_variants(more)) == brute_variants(brute_words(local(odd)))
    repeated = odd.unionByName(odd).unionByName(odd)
    assert variants(spelling_variants(repeated)) == brute_variants(brute_words(local(repeated)))
    assert spelling_variants(odd.limit(0)).count() == 0


def test_spelling_of_crowded_halves(spark, monkeypatch):
    """Many words share one half, so its group is split; chains of forms are followed to their ends; letters repeat."""
    rng = np.random.default_rng(5)
    n = {"aaa" + "".join(rng.choice(list("abé"), size=k)): int(rng.integers(5, 4000)) for k in rng.integers(3, 7, 700)}
    n |= {"".join(rng.choice(list("ab"), size=k)) + "aaa": int(rng.integers(5, 4000)) for k in rng.integers(3, 7, 200)} | {"a" * k: 7**k for k in range(6, 12)}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    want = brute_variants(n)
    for bucket in (1 << 16, 50):
        monkeypatch.setattr(spelling, "BUCKET", bucket)
        links = near_words(words).collect()
        assert len(links) == len({(r.word, r.near) for r in links}) == sum(w[3] for w in want.values())
        assert all(is_near(r.word, r.near) and r.near_n == n[r.near] for r in links)
    assert max(collections.Counter(w[:3] for w in n).values()) > 50 * 4


def test_automaton_numbers_words():
    words = sorted({"tap", "taps", "top", "tops", "stop", "stops", "a", "aa", "aaa"})
    a = Automaton(words)
    for k, w in enumerate(words):
        state, number = a.walk(a.start, 0, w)
        assert a.final[state] and number == k
    assert a.walk(a.start, 0, "tax") is None
    assert len(a.steps) < sum(map(len, words))  # ends are shared
    for half, rest in (("", "aa"), ("t", "op"), ("t", "aps"), ("st", "ops"), ("", "")):
        got = {words[k] for k in a.with_one_error(half, rest)}
        assert got == {w for w in words if w.startswith(half) and is_near(half + rest, w)}, (half, rest)
    assert Automaton([]).with_one_error("a", "b") == set()


def test_checksums_of_spans():
    body = np.frombuffer("".join(chr(97 + k % 26) for k in range(1000)).encode(), np.uint8)
    starts, ends = np.array([0, 3, 3, 10, 500]), np.array([3, 3, 67, 400, 565])
    seeds = np.array([zlib.crc32(b"12:")] * 5, np.uint32)
    assert crc32_spans(body, starts, ends, seeds).tolist() == [zlib.crc32(b"12:" + body[a:b].tobytes()) for a, b in zip(starts, ends)]


def test_words_that_lose_a_letter(spark):
    rows = [(i, "Änderung ÉTÉSxx " * 3 + "x" * 100, None) for i in range(800)]
    df = spark.createDataFrame([(*r, "s", 0) for r in rows], SCHEMA)
    got = {r.word: r.n for r in corpus_words(df, least_count=1).collect()}
    every = collections.Counter()
    for i, t, _ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{i}:{w}".encode())
            every[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    assert got == {w: k for w, k in every.items() if len(w) >= 6} and len(got) > 3


def fingerprint_of(text):
    w = WORD.findall((text or "").translate(LOWER))
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints):
    """(id, fingerprint) rows to the smallest id reachable, by all pairs."""
    distinct = np.array(sorted({f for _, f in prints}), np.uint64)
    root = list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(distinct)):
        for b in np.flatnonzero(np.bitwise_count(distinct[a + 1 :] ^ distinct[a]) <= 4) + a + 1:
            x, y = find(a), find(int(b))
            root[max(x, y)] = min(x, y)
    at = {int(f): find(k) for k, f in enumerate(distinct)}
    low = {}
    for i, f in prints:
        if i is not None:
            low[at[f]] = min(low.get(at[f], i), i)
    return [(i, f"{f:016x}", low.get(at[f])) for i, f in prints]


def classes(df):
    return sorted(map(str, (tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect())))


def test_simhash_duplicates(spark, data, docs, odd):
    for df in (docs, odd):
        want = sorted(map(str, brute_classes([(i, fingerprint_of(t)) for i, t, _ in local(df)])))
        assert classes(simhash_duplicates(df)) == want
    assert classes(simhash_duplicates(odd.select("*", *[F.lit(7).alias(c) for c in NAMES]))) == want
    nulls = simhash_duplicates(odd.where("doc_id is null")).collect()
    assert [r.component_id for r in nulls] == [None, None] and nulls[0].component_key != nulls[1].component_key
    assert simhash_duplicates(odd.limit(0)).count() == 0


def test_balls_of_fingerprints_meet(spark, monkeypatch):
    """Dense clusters, chains and strangers; more slices than a test's rows would have."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64) * np.uint64(2)
    prints = {int(f) for f in base}
    for f in base[:20]:
        for _ in range(12):
            flip = rng.choice(64, size=int(rng.integers(1, 7)), replace=False)
            prints.add(int(f) ^ sum(1 << int(b) for b in flip))
    prints |= {0, 15, 31, (1 << 64) - 1, (1 << 63)}
    rows = [(k, f) for k, f in enumerate(sorted(prints))]
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for _, f in rows], "f long")
    d = np.array([f for _, f in rows], np.uint64)
    far = lambda u, v: bin((u ^ v) & (1 << 64) - 1).count("1")
    want = {k: c for (k, _), (_, _, c) in zip(rows, brute_classes(rows))}
    for part in (1 << 20, 64):
        monkeypatch.setattr(simhash, "PART", part)
        links = near_fingerprints(df).collect()
        assert links and all(0 < far(r.u, r.v) <= 4 for r in links) and len(set(map(tuple, links))) == len(links)
        root = list(range(len(d)))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        at = {f: k for k, f in rows}
        for r in links:
            x, y = find(at[r.u & (1 << 64) - 1]), find(at[r.v & (1 << 64) - 1])
            root[max(x, y)] = min(x, y)
        assert {k: find(k) for k in range(len(d))} == want


def test_crowded_halves_and_strangers(spark, monkeypatch):
    """Fingerprints that share a half or nearly, most far from each other in the rest: compared, by balls, and some of both."""
    rng = np.random.default_rng(5)
    one = lambda b: np.uint64(1) << np.asarray(b, np.uint64)
    rest = rng.integers(0, 1 << 32, 60, dtype=np.uint64)
    high = np.uint64(0xDEADBEEF00000000)
    prints = {int(high ^ r) for r in rest} | {int(high ^ r ^ one(rng.integers(0, 32)) ^ one(rng.integers(32, 64))) for r in rest[:30]}
    prints |= {int(high ^ rest[0] ^ one(a) ^ one(b)) for a, b in itertools.combinations(range(0, 64, 5), 2)}  # dense: up to 4 apart
    prints |= {int(f) for f in (rest << np.uint64(32)) ^ np.uint64(77)} | {(1 << 63), 0, (1 << 64) - 1}
    rows = list(enumerate(sorted(prints)))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for _, f in rows], "f long")
    want = collections.defaultdict(set)
    for (_, f), (_, _, c) in zip(rows, brute_classes(rows)):
        want[c].add(f)
    for crowd in (1024, 70, 3, 1):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        links = [(r.u & (1 << 64) - 1, r.v & (1 << 64) - 1) for r in near_fingerprints(df).collect()]
        assert len(set(links)) == len(links) and all(0 < (u ^ v).bit_count() <= 4 for u, v in links)
        near = collections.defaultdict(set)
        for u, v in links:
            near[u].add(v)
            near[v].add(u)
        for own in want.values():
            seen, todo = set(), [min(own)]
            while todo:
                if (f := todo.pop()) not in seen:
                    seen.add(f)
                    todo += near[f]
            assert seen == own


def test_fingerprints_send_few_bytes(spark):
    """What one fingerprint writes to shuffle files doesn't fill the disks: it was 16 kB."""
    n = 9000
    prints = np.random.default_rng(6).integers(-(1 << 63), 1 << 63, n, dtype=np.int64)
    df = spark.createDataFrame([(int(f),) for f in prints], "f long")
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext.setJobGroup("few bytes", "")
    try:
        assert near_fingerprints(df).count() == 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("few bytes") for s in tracker.getJobInfo(j).stageIds}
    written = sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages)
    assert 0 < written < 1000 * n


def test_flips_and_majority():
    f = simhash.FLIPS
    assert len(f) == len(set(f.tolist())) == 2081 and int(np.bitwise_count(f).max()) == 2
    h = np.random.default_rng(1).integers(0, 1 << 63, 200_000, dtype=np.uint64)
    row = np.sort(np.random.default_rng(2).integers(0, 3, len(h)))
    got = simhash.majority(h, row, 4)
    for k in range(3):
        own = h[row == k]
        assert int(got[k]) == sum(1 << b for b in range(64) if 2 * int((own >> np.uint64(b) & np.uint64(1)).sum()) > len(own))
    assert got[3] == 0
    even = np.array([1, 2], np.uint64)  # half isn't over half
    assert simhash.majority(even, np.zeros(2, np.int64), 1).tolist() == [0]


def test_blocks_give_fingerprints_back():
    prints = np.random.default_rng(4).integers(0, 1 << 63, 50, dtype=np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(np.r_[prints, prints[:1] ^ 3])], names=["f"])
    for bits, parts in ((12, 4), (13, 8192)):
        met = set()
        for turn in range(simhash.ROUNDS):
            for out in simhash._emit(bits, parts, turn)([batch]):
                t = pa.Table.from_batches([out])
                met |= {tuple(r.values()) for r in simhash._meet(bits)(t).to_pylist()}
        assert met == {(max(prints[0], prints[0] ^ 3), min(prints[0], prints[0] ^ 3))}
