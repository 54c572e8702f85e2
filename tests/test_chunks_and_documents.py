"""Chunk files, whole documents, and the defined results of missing values."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators.ema import ema
from tideline.operators.labels import window_metrics
from tideline.operators.normalise import normalise
from tideline.operators import stability
from tideline.operators.stability import stabilise, stabilise_long
from tideline.sources import chunks, tables
from tideline.sources.store import RunStore
from tideline.streaming import replay

T0 = 1_600_041_600


@pytest.fixture(scope="module")
def tape(spark):
    """A day and a half over a month's end, of two series, with a hole in one."""
    start = 1_601_424_000  # 2020-09-30
    one = tables.synthetic(spark, 30_000, start + 60_000, "a/b").where(f"ts < {start + 80_000} or ts >= {start + 80_010}")
    return one.unionByName(tables.synthetic(spark, 5_000, start, "c", seed=9)).drop("row").cache()


def test_chunk_files(spark, tape, tmp_path):
    path = str(tmp_path / "store")
    chunks.write_chunks(tape, path, 1, "X")
    catalogue = chunks.read_catalogue(path)
    assert catalogue["n_chunks"] == 4 == len(list((tmp_path / "store").glob("*/*.npz"))) and catalogue["n_seconds"] == tape.count()
    d = chunks.read_chunks(spark, path)
    keys = ["series", "ts", "close", "gap", "trades"]
    shown = lambda x: sorted(map(tuple, x.select(*[F.round(c, 6) if c == "close" else F.col(c) for c in keys]).collect()))
    assert shown(d) == shown(tape)
    # layout and meaning of a chunk's arrays
    first = next(c for c in catalogue["chunks"] if c["series"] == "c")
    with np.load(f"{path}/{first['file']}") as z:
        own = tape.where("series = 'c'").orderBy("ts").toPandas()
        assert int(z["n"]) == 5000 and int(z["t0"]) == first["t0"] == own["ts"][0] and z["trades_u16"].dtype == np.uint16
        cents = np.rint(own["close"].to_numpy() * 100).astype(np.int64)
        assert (np.cumsum(z["close_delta"].astype(np.int64)) == cents).all() and (np.unpackbits(z["gap_bits"])[:5000] == own["gap"]).all()
        assert (z["volume_i"] == np.rint(own["volume"].to_numpy() * 10_000)).all()


def test_chunks_are_skipped_by_the_catalogue(spark, tape, tmp_path):
    path = str(tmp_path / "store")
    chunks.write_chunks(tape, path, 1)
    d, start = chunks.read_chunks(spark, path), 1_601_424_000
    assert d.rdd.getNumPartitions() == 4
    for where, n in ((f"ts >= {start + 86_400}", 1), ("series = 'c'", 1), ("series IN ('c', 'x')", 1), (f"ts = {start + 80_010}", 1), (f"ts < {start + 60_000}", 1), (f"ts <= {start + 60_000}", 2), (f"ts > {start + 79_999} AND ts < {start + 80_010}", 0)):
        got = d.where(where)
        assert got.count() == tape.where(where).count(), where
        assert len([f for f in range(got.rdd.getNumPartitions())]) == max(n, got.rdd.getNumPartitions() if n == 0 else n), where
    # files that the range doesn't need may be gone: they aren't opened
    for f in (tmp_path / "store").glob("a*/*.npz"):
        f.unlink()
    assert chunks.chunk_range(spark, path, 0, start + 60_000).count() == 5_000
    with pytest.raises(ValueError, match="no bars"):
        chunks.chunk_range(spark, path, 0, 5)
    with pytest.raises(FileNotFoundError):
        chunks.read_catalogue(str(tmp_path / "none"))


def test_chunks_append_replace_and_abort(spark, tape, tmp_path):
    path = str(tmp_path / "store")
    chunks.write_chunks(tape.where("series = 'c'"), path, 1)
    before = chunks.read_catalogue(path)
    chunks.write_chunks(tape.where("series <> 'c'"), path, 1, append=True)
    assert chunks.read_chunks(spark, path).count() == tape.count()
    bad = tape.where("series = 'c'").withColumn("high", F.when(F.col("ts") % 5000 == 4999, 1e9).otherwise(F.col("high")))
    with pytest.raises(Exception, match="32 bits"):
        chunks.write_chunks(bad, path, 1)
    assert chunks.read_chunks(spark, path).count() == tape.count()  # the catalogue is the old one
    chunks.write_chunks(tape.where("series = 'c'"), path, 1)
    assert chunks.read_catalogue(path)["n_chunks"] == before["n_chunks"] == 1
    with pytest.raises(ValueError, match="version"):
        chunks.unpack_chunk(changed_version(f"{path}/{chunks.read_catalogue(path)['chunks'][0]['file']}"), 1)


def changed_version(path):
    import io

    with np.load(path) as z:
        x = dict(z)
    out = io.BytesIO()
    np.savez(out, **{**x, "schema": np.int32(99)})
    return out.getvalue()


def test_documents_are_whole_at_any_time(spark, tmp_path):
    store = RunStore(spark, str(tmp_path), "run")
    store.write_document("live.json", {"v": 0, "x": "a" * 5000})
    seen, stop = [], threading.Event()

    def poll():
        while not stop.is_set():
            text = (tmp_path / "run" / "live.json").read_text()
            seen.append((text[:5], len(text) > 5000))

    t = threading.Thread(target=poll)
    t.start()
    for v in range(1, 6):
        store.write_document("live.json", {"v": v, "x": "a" * 5000})
    stop.set()
    t.join()
    assert all(whole and head == '{"v":' for head, whole in seen) and seen
    assert store.read_document("live.json")["v"] == 5
    assert sorted(p.name for p in (tmp_path / "run").iterdir() if not p.name.startswith(".")) == ["live.json"]


def test_live_state_takes_a_micro_batch_once(spark, tmp_path, monkeypatch):
    kept = {}
    rows = spark.createDataFrame([("s", k, float(k)) for k in range(6)], "series string, ts long, v double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    writer = type(s.writeStream)
    plain = writer.foreachBatch
    monkeypatch.setattr(writer, "foreachBatch", lambda self, f: plain(self, kept.setdefault("f", f)))
    replay.live_state(s, str(tmp_path / "live"), str(tmp_path / "c"), most=4).awaitTermination()
    show = lambda: [(p.ts, p.v) for p in spark.read.json(str(tmp_path / "live")).first().points]
    assert show() == [(k, float(k)) for k in range(2, 6)]
    kept["f"](rows, 0)  # again
    assert show() == [(k, float(k)) for k in range(2, 6)]
    kept["f"](spark.createDataFrame([("s", 5, -5.0), ("s", 6, 6.0)], rows.schema), 1)
    assert show() == [(3, 3.0), (4, 4.0), (5, -5.0), (6, 6.0)]


def test_klines_of_other_lengths_are_dropped(spark, tmp_path):
    fields = ["1600000000000", "1", "9", "1", "2.5", "10", "0", "15", "3", "4", "0", "0", "0", "0"]
    lines = [",".join([str(1600000000000 + 1000 * n), *fields[1:n]]) for n in range(5, 15)] + ["t,open", ",".join(["1600000099000", "x", *fields[2:12]])]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    got = tables.klines(spark, str(tmp_path / "a.csv"), "x").collect()
    assert sorted(r.ts - 1600000000 for r in got) == [10, 11, 12] and all(r.quote_volume == 15 and r.taker_buy_base == 4 for r in got)


def test_filter_of_missing_values(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [("s", k, None if k % 9 == 4 or k == 0 else float(rng.normal()), None if k % 5 == 2 else float(rng.random())) for k in range(200)]
    df = spark.createDataFrame(rows, "series string, row long, mu double, sigma double")
    batch = {r.row: (r.mu_smooth, r.clipped) for r in stabilise(df, ["series"]).collect()}
    assert batch[0][0] is None and all(batch[k][0] == batch[k - 1][0] for k in range(4, 200, 9)) and batch[199][0] is not None
    replay.replay_store(df, str(tmp_path / "in"), "row", 3)
    out = replay.drained(replay.stream_stability(replay.stream(spark, str(tmp_path / "in"), df.schema)), str(tmp_path / "c"))
    assert {r.row: (r.mu_smooth, r.clipped) for r in out.collect()} == batch


def test_normaliser_of_null_windows_and_other_keys(spark):
    rows = [(7, k, None if 40 <= k < 80 else float(k % 11), float(k)) for k in range(160)]
    df = spark.createDataFrame(rows, "series int, row long, x double, y double")
    got = {r.row: r for r in normalise(df, ["x", "y"], 40).collect()}
    assert len(got) == 160 and all((got[k].z_x is None) == (40 <= k < 80) for k in range(160))
    mean, var, want = 0.0, 1.0, {}
    for w in range(4):
        want[w] = (mean, var)
        x = [float(k % 11) for k in range(40 * w, 40 * w + 40) if k % 40 % 17 == 0 and w != 1]
        if x:
            a = min(1.0, 1e-4 * len(x))
            mean, var = (1 - a) * mean + a * np.mean(x), (1 - a) * var + a * max(np.var(x), 1e-8)
    for k in (0, 39, 80, 159):
        m, v = want[k // 40]
        assert got[k].z_x == pytest.approx(np.clip((k % 11 - m) / np.sqrt(v + 1e-6), -8, 8))


def test_scores_count_labels(spark):
    rows = [("s", k, 100.0, 0.5, 1.0, float(k - 2) if k < 5 else None) for k in range(10)]
    r = window_metrics(spark.createDataFrame(rows, "series string, row long, close double, mu double, sigma double, target double"), ["series"]).first()
    y = np.arange(5) - 2.0
    assert r.n == 5 and r.r2 == pytest.approx(1 - ((0.5 - y) ** 2).sum() / (y.var() * 5)) and r.mae == pytest.approx(np.abs(0.5 - y).mean())


def test_average_of_a_missing_value_raises(spark):
    df = spark.createDataFrame([("s", 0, 1.0), ("s", 1, None)], "series string, row long, x double")
    with pytest.raises(Exception, match="missing value"):
        ema(df, {"y": (F.col("x"), 20, 0.0)}).collect()
    assert ema(df, {"y": (F.col("x"), 20, 0.0)}, carry=True).count() == 2


def test_filter_of_blocks_is_the_sequential_one(spark, monkeypatch):
    """To the last bit: noise, values that stand in the dead zone, holes in the numbering, missing values, short series."""
    rng = np.random.default_rng(6)
    kinds = {
        "noise": [(k, float(x)) for k, x in enumerate(rng.normal(0, 3, 5000))],
        "still": [(k, 1.0 if k < 700 else 1.2) for k in range(2000)],
        "holes": [(k, float(rng.normal())) for k in range(2500) if k % 900 < 500 or k > 2000],
        "missing": [(k, None if k < 300 or 800 < k < 1300 else float(rng.normal())) for k in range(1500)],
        "short": [(k, float(k)) for k in range(3)],
        None: [(k, float(rng.normal())) for k in range(600)],
    }
    rows = [(s, k, mu, float(rng.random())) for s, x in kinds.items() for k, mu in x]
    df = spark.createDataFrame(rows, "series string, row long, mu double, sigma double").repartition(4).cache()
    show = lambda d: {(r.series, r.row): (r.mu_smooth, r.clipped) for r in d.collect()}
    want = show(stabilise(df, ["series"]))
    assert len(want) == len(rows)
    for size, lead, rounds in ((256, 64, 8), (1024, 512, 8), (128, 16, 2), (65_536, 8_192, 8)):
        monkeypatch.setattr(stability, "ROUNDS", rounds)
        got = stabilise_long(df, ["series"], block=size, lead=lead)
        assert got.count() == len(rows) and show(got) == want, (size, lead, rounds)
    assert stabilise_long(df.limit(0), ["series"]).count() == 0
