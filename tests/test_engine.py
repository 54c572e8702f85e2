"""The time-series engine: invariants, and Spark against DuckDB on the small tables."""

import math
import os
import zipfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline import plans
from tideline.operators import blocks, codec, grid, labels, mlp, windows
from tideline.operators.ema import ema
from tideline.operators.online import OnlineSignals
from tideline.operators.signals import SIGNALS, signals
from tideline.operators.stability import SlewFilter, smoothness_gain, stabilise, stability_report
from tideline.sources import tables
from tideline.sources.store import (
    RunStore, append_metrics_table, append_table, append_tape, copy_files, create_tables, describe, files_by_year, named_windows, newest_run, read_manifest, rebuild_manifest,
    store_size, write_bars, write_manifest,
)
from tideline.streaming import replay

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


@pytest.fixture(scope="module")
def tape(spark):
    return tables.synthetic(spark, 4000, 1_600_041_600).cache()


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query(spark, data, duck, name):
    df = plans.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in columns) for r in df.collect()]
    result = duck.sql(plans.oracle_sql()[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    want = [tuple(norm(r[i]) for i in at) for r in result.fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_ema_is_the_loop(spark):
    x = np.random.default_rng(3).normal(size=5000)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "series string, row long, x double")
    got = ema(df, {"y": (F.col("x"), 300, 0.0), "one": (F.col("x"), 1, 0.0), "five": (F.col("x"), 5, 2.0)}).orderBy("row").toPandas()
    for name, span, y in (("y", 300, 0.0), ("five", 5, 2.0)):
        a, want = 2 / (span + 1), []
        for v in x:
            y = (1 - a) * y + a * v
            want.append(y)
        assert np.abs(got[name] - want).max() < 1e-9
    assert np.array_equal(got["one"], x)


def test_signals_are_causal_and_finite(spark, tape):
    cut = 3000
    moved = tape.withColumn("close", F.when(F.col("row") >= cut, F.col("close") * 1.05).otherwise(F.col("close")))
    a, b = (signals(t).where(F.col("row") < cut).orderBy("row").toPandas() for t in (tape, moved))
    assert len(SIGNALS) == 40 and list(a.columns[4:]) == list(SIGNALS)
    assert np.abs(a[list(SIGNALS)].values - b[list(SIGNALS)].values).max() < 1e-9
    assert np.isfinite(a[list(SIGNALS)].values).all()


def test_codec_roundtrip(tape):
    both = codec.decode(codec.encode(tape)).alias("d").join(tape.alias("o"), ["series", "row"])
    r = both.agg(*[F.max(F.abs(F.col(f"d.{c}") - F.bround(f"o.{c}", 2))).alias(c) for c in ("open", "high", "low", "close")], F.count_if(F.col("d.gap") & (F.col("d.volume") > 0)).alias("bad")).first()
    assert max(r.open, r.high, r.low, r.close) < 1e-9 and r.bad == 0
    with pytest.raises(Exception, match="32 bits"):
        codec.encode(tape.limit(5).withColumn("close", F.lit(1e9))).collect()


def test_klines(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "open_time,open,high,low,close,volume,close_time,quote_volume,count,taker,tq,ignore\n"
        "1600000000000,1,2,0.5,1.5,10,0,15,3,4,0,0\nbroken,line\n1600000000000,1,3,0.5,1.7,10,0,15,3,4,0,0\n1600000002000000,2,2,2,2,1,0,2,1,0,0,0\n"
    )
    bars = tables.klines(spark, str(tmp_path / "a.csv"), "x")
    g = grid.on_grid(bars, 1).orderBy("ts").collect()
    assert [(r.ts, r.close, r.gap, r.volume) for r in g] == [(1600000000, 1.7, False, 10.0), (1600000001, 1.7, True, 0.0), (1600000002, 2.0, False, 1.0)]
    other = bars.withColumn("ts", F.col("ts") + 86400)
    assert tables.with_fallback(bars, bars.unionByName(other), 86400).count() == 4
    assert tables.with_fallback(bars, bars.unionByName(other)).count() == 2
    assert tables.with_fallback(bars, bars.unionByName(bars.withColumn("ts", F.col("ts") + 40 * 86400))).count() == 4
    from tideline.functions import scalars

    r = spark.sql("SELECT 0.125D AS x, 0.375D AS y, -0.125D AS z").select(*[scalars.even(F.col(c), 2).alias(c) for c in "xyz"]).first()
    assert tuple(r) == (0.12, 0.38, -0.12)


def test_stability_filter(spark):
    rng = np.random.default_rng(5)
    mu = np.cumsum(rng.normal(0, 0.5, 1800))
    df = spark.createDataFrame([("a", i, float(m), 1.0) for i, m in enumerate(mu)], "series string, row long, mu double, sigma double")
    out = df.join(stabilise(df, ["series"]), ["series", "row"])
    r = stability_report(out, ["series"], "mu_smooth", limit=0.08 + 1e-9).first()
    assert r.max_slew <= 0.08 + 1e-12 and r.breaches == 0
    assert smoothness_gain(out, ["series"], "mu", "mu_smooth").first().gain > 0
    f, g = SlewFilter(), SlewFilter()
    for m in mu[:100]:
        f.step(m)
    g = SlewFilter(state=f.state())
    assert [f.step(m) for m in mu[100:200]] == [g.step(m) for m in mu[100:200]]


def test_prices_and_labels(spark, tape):
    d = labels.with_labels(tape, 100)
    r = d.select(F.max(F.abs(F.col("close") * F.exp(F.col("target") / 1000) - F.col("future_price"))).alias("e"), F.count_if(F.col("target").isNull()).alias("n")).first()
    assert r.e < 1e-6 and r.n == 100


def test_windows(tape):
    d = windows.full_windows(tape, 1800)
    assert sorted((r.window_id, r["count"]) for r in d.groupBy("window_id").count().collect()) == [(0, 1800), (1, 1800)]


def test_network_learns(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8))
    rows = [("l%d" % (i % 2), i, *map(float, v), float(3 * v[0] - 2 * v[1])) for i, v in enumerate(x)]
    names = [f"f{k}" for k in range(8)]
    df = spark.createDataFrame(rows, "lane string, row long, " + ", ".join(f"{n} double" for n in names) + ", target double").cache()
    w, losses = mlp.train(df, names, "lane", "row", steps=12, rate=0.05)
    assert losses[-1] < 0.9 * losses[0]
    assert mlp.predict(df, w, names).where("mu is null").count() == 0
    # gradients against differences
    w = mlp.init(3, 4, 2)
    x, y = rng.normal(size=(20, 3)), rng.normal(size=20)
    _, g = mlp.gradient(w, x, y)
    flat, got = mlp.pack(w), mlp.pack(g)
    for i in (0, 5, len(flat) - 1):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (mlp.gradient(mlp.unpack(up, w), x, y)[0] - mlp.gradient(mlp.unpack(down, w), x, y)[0]) / 2e-6
        assert slope == pytest.approx(got[i], rel=1e-4, abs=1e-6)


def test_stores(spark, tape, tmp_path):
    write_bars(tape, str(tmp_path / "bars"))
    stored = spark.read.parquet(str(tmp_path / "bars"))
    assert tables.time_range(stored, 1_600_041_700, 1_600_041_800).count() == 100
    write_manifest(stored, str(tmp_path / "m"), 1, {"symbol": "X"})
    m = read_manifest(spark, str(tmp_path / "m")).first()
    assert (m.n_seconds, m.t_end - m.t_start, m.symbol) == (4000, 4000, "X")
    store = RunStore(spark, str(tmp_path), "run1")
    rows = tape.select((F.col("row") - F.col("row") % 1000).alias("window_id"), "ts", F.col("close").alias("price_now"), F.lit(0).alias("lane"))
    store.save_windows(rows)
    store.save_windows(rows.where("window_id = 1000").withColumn("target", F.lit(1.0)))
    t = store.tape()
    assert t.count() == 4000 and t.where("target = 1").count() == 1000
    assert store.series(last=1, lane=0).count() == 1000
    assert spark.read.parquet(store.consolidate(str(tmp_path / "one"))).where("target is null").count() == 3000
    store.append_metrics(spark.createDataFrame([(1, 0.5)], "window long, mae double"))
    store.append_metrics(spark.createDataFrame([(2, 0.4)], "window long, mae double"))
    assert store.metrics().count() == 2
    store.write_document("run.json", {"a": {"b": 1}})
    assert store.read_document("run.json") == {"a": {"b": 1}}
    assert store.load_checkpoint() is None
    for k in range(3):
        store.save_checkpoint(k, {"model": {"w": [1.0, k]}, "n": k}, keep=2)
    assert store.load_checkpoint() == (2, {"model": {"w": [1.0, 2.0]}, "n": 2}) and store.load_checkpoint(0) is None
    weights = mlp.init(3, 4)
    store.save_checkpoint(9, {"net": weights, "steps": np.arange(6, dtype=np.int32).reshape(2, 3), "rate": 0.5})
    window, blob = store.load_checkpoint()
    assert window == 9 and blob["rate"] == 0.5 and blob["steps"].dtype == np.int32 and blob["steps"].tolist() == [[0, 1, 2], [3, 4, 5]]
    assert all(np.array_equal(blob["net"][k], w) and blob["net"][k].shape == w.shape for k, w in weights.items())
    spark.sql(f"CREATE TABLE tape_test (window_id long, ts long) USING parquet LOCATION '{tmp_path}/w'")
    append_table(rows, "tape_test")
    append_table(rows.select("window_id").limit(3), "tape_test")
    assert spark.table("tape_test").count() == 4003 and spark.table("tape_test").where("ts is null").count() == 3
    spark.sql("DROP TABLE tape_test")


def test_warehouse(spark, tape):
    create_tables(spark, "wh_tape", "wh_metrics")
    try:
        rows = tape.select((F.col("row") - F.col("row") % 1000).alias("window_id"), "ts", F.col("close").alias("price_now"), F.lit(float("nan")).alias("target_permille"))
        append_tape(rows, "wh_tape", "r1", newest=2)
        got = spark.table("wh_tape")
        assert got.count() == 2000 and got.where("target_permille is null and lane is null and run_id = 'r1'").count() == 2000
        assert got.agg(F.min(F.unix_timestamp("ts"))).first()[0] == 1_600_041_600 + 2000
        m = spark.createDataFrame([("1", "2020-01-01", " ", "0.5", "x")], "window string, utc string, loss string, mae_permille string, extra string")
        append_metrics_table(m.withColumn("calibration", F.lit("n/a")), "wh_metrics", "r1")
        r = spark.table("wh_metrics").first()
        assert (r.run_id, r.window, r.utc, r.loss, r.mae_permille, r.calibration, r.jitter_permille) == ("r1", 1, "2020-01-01", None, 0.5, None, None)
    finally:
        spark.sql("DROP TABLE wh_tape")
        spark.sql("DROP TABLE wh_metrics")


def test_files(spark, tape, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_manifest(spark, str(tmp_path / "none"))
    write_bars(tape, str(tmp_path / "bars"))
    (tmp_path / "bars" / "month=2020-09" / "broken.parquet").write_bytes(b"not a table")
    rebuild_manifest(spark, str(tmp_path / "bars"), str(tmp_path / "m"), 1)
    r = describe(spark, str(tmp_path / "m")).first()
    assert r.bars == 4000 and r.mb > 0 and r.days == pytest.approx(4000 / 86400, abs=1e-6)
    (tmp_path / "empty.json").write_text('{"chunks": []}')
    with pytest.raises(ValueError):
        read_manifest(spark, str(tmp_path / "empty.json"))
    with pytest.raises(ValueError):
        tables.clamped_range(tape, 0, 10)
    assert tables.clamped_range(tape, 0, 1_600_041_600 + 7).count() == 7
    for run, when in (("a", 1000), ("b", 3000), ("c", 2000)):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "live.json").write_text("{}")
        os.utime(tmp_path / "runs" / run / "live.json", (when, when))
    assert newest_run(spark, str(tmp_path / "runs")) == "b"
    assert tuple(store_size(spark, str(tmp_path / "runs"), r"\.json$").first()) == (3, 6)
    assert copy_files(spark, str(tmp_path / "runs" / "a"), str(tmp_path / "copy")) == 1 and copy_files(spark, str(tmp_path / "runs" / "b"), str(tmp_path / "copy")) == 0
    names = spark.createDataFrame([("x-2019-01.csv",), ("x-2020-02.csv",), ("y-2019-12.csv",), ("none",)], "name string")
    assert {r.year: r.names for r in files_by_year(names).collect()} == {2019: ["x-2019-01.csv", "y-2019-12.csv"], 2020: ["x-2020-02.csv"]}
    assert tuple(named_windows(spark.createDataFrame([("w00001002_r1.npz",)], "name string")).first()) == ("w00001002_r1.npz", 1, 2, 1)
    store = RunStore(spark, str(tmp_path), "run2")
    store.save_windows(tape.select((F.col("row") / 1000).cast("long").alias("window_id"), "ts", F.col("close").alias("price_now"), (F.col("row") % 2).alias("lane")))
    assert [w.agg(F.min("window_id"), F.count("*")).first() for w in store.windows(1, 2)] == [(1, 1000), (2, 1000)] and not list(store.windows(seconds=0.0))
    store.write_live({"step": 4}, every=100)
    live = store.read_document("live.json")
    assert live["step"] == 4 and len(live["rows"]) == 10 and {r["window_id"] for r in live["rows"]} == {3}


def test_klines_over_files(spark, tmp_path):
    line = lambda t, c: f"{t},1,9,1,{c},10,0,15,3,4,0,0\n"
    (tmp_path / "a.csv").write_text(line(1600000000000, 1.5))
    (tmp_path / "b.csv").write_text("".join(line(1600000000000 + 1000 * k, 2.5 + k) for k in range(50)))
    close = lambda paths: tables.klines(spark, paths, "x").where("ts = 1600000000").first().close
    a, b = str(tmp_path / "a.csv"), str(tmp_path / "b.csv")
    assert (close([a, b]), close([b, a])) == (2.5, 1.5)
    with zipfile.ZipFile(tmp_path / "k.zip", "w") as z:
        z.write(a, "a.csv")
        z.write(b, "b.csv")
    bars = tables.zipped_klines(spark, str(tmp_path / "k.zip"), "x")
    assert bars.count() == 50 and bars.where("ts = 1600000000").first().close == 2.5


def test_ema_nulls_and_steep_weights(spark):
    x = [None, 10.0, None, 10.0, float("nan"), 4.0] + [None if k % 7 == 0 else float(k % 5) for k in range(9000)]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(x)], "series string, row long, x double")
    got = ema(df, {"y": (F.col("x"), 20, F.lit(None))}, carry=True).orderBy("row").toPandas()["y"].tolist()
    y, a = None, 2 / 21
    for k, v in enumerate(x):
        if v is not None and v == v:
            y = v if y is None else (1 - a) * y + a * v
        if y is not None:
            assert got[k] == pytest.approx(y, abs=1e-9)
    full = df.withColumn("x", F.coalesce(F.nanvl("x", F.lit(1.0)), F.lit(1.0)))
    for span in (1.000001, 1.0 + 1e-12, 1.5, 5e9):
        z = full.orderBy("row").toPandas()["x"].tolist()
        got = ema(full, {"y": (F.col("x"), span, 3.0)}).orderBy("row").toPandas()["y"].tolist()
        y, a = 3.0, 2 / (span + 1)
        for k, v in enumerate(z):
            y = (1 - a) * y + a * v
            assert got[k] == pytest.approx(y, abs=1e-9)


def test_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(s, k, None if rng.random() < 0.3 else float(rng.integers(100))) for s in "ab" for k in range(0, 9000, 1 if s == "a" else 3)]
    df = spark.createDataFrame(rows, "series string, row long, x double").repartition(7)
    block = F.floor(F.col("row") / 100)
    d = blocks.previous(df, "series", "row", block, "row", "before")
    d = blocks.running_sum(d.withColumn("one", F.coalesce("x", F.lit(0.0))), "series", "row", block, "one", "sum")
    got = {(r.series, r.row): r for r in blocks.last_known(d, "series", "row", block, "x").collect()}
    last, before, total = {}, {}, {}
    for s, k, x in rows:
        last[s] = x if x is not None else last.get(s)
        total[s] = total.get(s, 0.0) + (x or 0.0)
        r = got[s, k]
        assert (r.x, r.before) == (last[s], before.get(s)) and r.sum == pytest.approx(total[s])
        before[s] = k


def test_online_signals(spark, tape):
    """Row by row, over saved states and looks ahead, the engine gives what the batch gives; a hole begins it anew."""
    bars = [r.asDict() for r in tape.orderBy("row").limit(2500).collect()]
    want = signals(tape.where("row < 2500")).orderBy("row").toPandas()[list(SIGNALS)].values
    engine = OnlineSignals()
    got = engine.update(bars[:1200])
    ahead = engine.update(bars[1200:1300], advance=False)
    engine = OnlineSignals(state=engine.state())
    rest = engine.update(bars[1200:])
    assert ahead == rest[:100] and engine.resets == 0
    assert np.abs(np.array(got + rest) - want).max() < 1e-6
    again = OnlineSignals().update(bars[2000:2100])
    assert engine.update([bars[2000]])[0] == again[0] and engine.resets == 1 and engine.update(bars[2001:2100]) == again[1:]


def test_live_state(spark, tape, tmp_path):
    replay.replay_store(tape.where("row < 300").select("series", "ts", "row", "close"), str(tmp_path / "in"), "row", 3)
    s = replay.stream(spark, str(tmp_path / "in"), tape.select("series", "ts", "row", "close").schema)
    replay.live_state(s.select("series", "ts", "close"), str(tmp_path / "live"), str(tmp_path / "c"), most=50).awaitTermination()
    r = spark.read.json(str(tmp_path / "live")).first()
    assert [p.ts for p in r.points] == list(range(1_600_041_600 + 250, 1_600_041_600 + 300))


def test_stream_resets_at_holes(spark, tape, tmp_path):
    rows = tape.where("row < 400 and (row < 150 or row >= 200)")
    replay.replay_store(rows, str(tmp_path / "in"), "row", 4)
    out = replay.drained(replay.stream_signals(replay.stream(spark, str(tmp_path / "in"), rows.schema), 1), str(tmp_path / "c"))
    got = out.orderBy("ts").toPandas()
    assert got["resets"].tolist() == [0] * 150 + [1] * 200
    want = signals(windows.per_epoch(rows.drop("row"), 1)).orderBy("ts").toPandas()
    assert np.abs(got[list(SIGNALS)].values - want[list(SIGNALS)].values).max() < 1e-6


def test_network_is_the_loop(spark):
    """Training with contexts against the same steps in one process."""
    rng = np.random.default_rng(4)
    rows = [(s, i, float(rng.normal()), float(rng.normal())) for s in ("a", "b") for i in range(200)]
    df = spark.createDataFrame(rows, "series string, row long, f double, target double")
    d, names = mlp.with_contexts(df, ["f"])
    assert names == ["f", "f_ctx15", "f_ctx120", "f_ctx900"]
    w, losses = mlp.train(d, names, "series", "row", steps=4, rate=0.02)
    lanes = []
    for s in ("a", "b"):
        f, y = (np.array([r[k] for r in rows if r[0] == s]) for k in (2, 3))
        x = [f]
        for span in mlp.CONTEXTS:
            a, m, out = 2 / (span + 1), f[0], []
            for v in f:
                m = (1 - a) * m + a * v
                out.append(m)
            x.append(np.array(out))
        lanes.append((np.stack(x, 1), y))
    v, adam, want = mlp.init(4), mlp.Adam(0.02), []
    for _ in range(4):
        parts = [mlp.gradient(v, x, y) for x, y in lanes]
        want.append(sum(p[0] for p in parts) / 400)
        v = mlp.unpack(adam.step(mlp.pack(v), sum(mlp.pack(p[1]) for p in parts) / 400), v)
    assert losses == pytest.approx(want, rel=1e-9)
    assert all(np.allclose(w[k], v[k], atol=1e-9) for k in v)


def test_months(spark):
    got = [tuple(r) for r in tables.months(spark, "2023-12", "2024-02").collect()]
    assert [g[0] for g in got] == ["2023-12", "2024-01", "2024-02"] and all(b - a in (31 * 86400, 29 * 86400) for _, a, b in got)
    assert math.isclose(got[0][1], 1701388800)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
