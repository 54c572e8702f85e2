"""The full objective, training in step, the deep network's layers, and the walk forward, against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import deep, training
from tideline.operators.labels import window_metrics
from tideline.operators.mlp import pack, unpack
from tideline.operators.stability import SlewFilter
from tideline.sources.walk import WalkForward


def lanes(seed=3, sizes=(90, 41, 7)):
    rng = np.random.default_rng(seed)
    return {f"lane{k}": (rng.normal(size=(n, 3)), 2 * rng.normal(size=n)) for k, n in enumerate(sizes)}


def frame(spark, data, first=0):
    rows = [(k, first + i, *map(float, x[i]), None if np.isnan(y[i]) else float(y[i])) for k, (x, y) in data.items() for i in range(len(y))]
    return spark.createDataFrame(rows, "series string, row long, a double, b double, c double, target double").repartition(3)


def plain_loss(w, data):
    """Loss and terms, from their definition, with loops."""
    y_all = np.concatenate([y[np.isfinite(y)] for _, y in data.values()])
    mean_move = np.abs(y_all).mean()
    parts = {t: [] for t in training.TERMS}
    for x, y in data.values():
        o = np.tanh(x @ w["w1"] + w["b1"]) @ w["w2"] + w["b2"]
        for i, (mu, ls, z) in enumerate(o):
            if i > 0:
                parts["smooth"].append((mu - o[i - 1, 0]) ** 2)
            if i > 1:
                parts["curve"].append((mu - 2 * o[i - 1, 0] + o[i - 2, 0]) ** 2)
            if not np.isfinite(y[i]):
                continue
            e, ls = mu - y[i], min(max(ls, -4), 4)
            huber = 0.5 * e * e if abs(e) <= 2 else 2 * (abs(e) - 1)
            parts["huber"].append(huber * (1 + 0.35 * abs(y[i]) / (0.25 + mean_move + 1e-6)))
            parts["nll"].append(0.5 * e * e * math.exp(-2 * ls) + ls)
            if abs(y[i]) > 0.25:
                p = 1 / (1 + math.exp(-z))
                parts["direction"].append(-math.log(p if y[i] > 0 else 1 - p))
    terms = {t: float(np.mean(v)) if v else 0.0 for t, v in parts.items()}
    return sum(training.TERMS[t] * v for t, v in terms.items()), terms


def plain_gradient(w, data):
    flat, out = pack(w), []
    for k in range(len(flat)):
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        out.append((plain_loss(unpack(up, w), data)[0] - plain_loss(unpack(down, w), data)[0]) / 2e-5)
    return np.array(out)


def start():
    w = training.init(3, 4, 1)
    return {**w, "w2": w["w2"] * 40}


@pytest.mark.parametrize("tasks,block", [(1, 4096), (4, 8), (3, 2)])
def test_training_in_step_is_plain_gradient_descent(spark, tasks, block):
    """Whatever the shares, and where lanes are cut: gradients by differences, AdamW written out, the rate along its cosine."""
    data = lanes()
    data["lane0"][1][5:9] = np.nan
    w, state, told = training.train_in_step(frame(spark, data), ["a", "b", "c"], "series", "row", 3, start(), tasks=tasks, block=block, rate=0.01)
    v, m, u = start(), 0.0, 0.0
    for k in range(3):
        loss, terms = plain_loss(v, data)
        assert told[k]["loss"] == pytest.approx(loss, rel=1e-6)
        assert all(told[k][t] == pytest.approx(x, rel=1e-6) for t, x in terms.items())
        g = plain_gradient(v, data)
        g = g * min(1, 1 / np.linalg.norm(g))
        m, u = 0.9 * m + 0.1 * g, 0.98 * u + 0.02 * g * g
        rate = 0.01 * (0.05 + 0.95 * (1 + math.cos(math.pi * k / 64)) / 2)
        assert told[k]["rate"] == pytest.approx(rate)
        flat = pack(v) * (1 - rate * 1e-4)
        v = unpack(flat - rate * (m / (1 - 0.9 ** (k + 1))) / (np.sqrt(u / (1 - 0.98 ** (k + 1))) + 1e-8), v)
    assert state["t"] == 3
    assert np.allclose(pack(w), pack(v), atol=2e-5)


def test_training_goes_on_from_its_state(spark):
    """Steps in two calls are the steps of one; missing features are 0; without rows there is no step."""
    d = frame(spark, lanes(5))
    one, _, told = training.train_in_step(d, ["a", "b", "c"], "series", "row", 4, start(), tasks=2)
    half, state, first = training.train_in_step(d, ["a", "b", "c"], "series", "row", 2, start(), tasks=2)
    two, _, then = training.train_in_step(d, ["a", "b", "c"], "series", "row", 2, half, state, tasks=2)
    assert np.allclose(pack(one), pack(two), atol=1e-12)
    assert [t["loss"] for t in told] == pytest.approx([t["loss"] for t in first + then], rel=1e-12)
    holes = d.withColumn("a", F.when(F.col("row") % 2 == 0, F.col("a")))
    zeros = d.withColumn("a", F.when(F.col("row") % 2 == 0, F.col("a")).otherwise(0.0))
    a, b = (training.train_in_step(x, ["a", "b", "c"], "series", "row", 1, start(), tasks=2)[2][0]["loss"] for x in (holes, zeros))
    assert a == pytest.approx(b, rel=1e-12)
    for nothing in (d.where("false"), d.where("row = 0").withColumn("target", F.lit(None))):
        none, state, told = training.train_in_step(nothing, ["a", "b", "c"], "series", "row", 1, start(), tasks=2)
        assert told == [] and state is None and np.array_equal(pack(none), pack(start()))


def test_rate_restarts():
    adam, rates = training.AdamW(1.0), []
    for _ in range(64 + 128 + 1):
        rates.append(adam.now())
        adam.step(np.zeros(1), np.zeros(1))
    assert rates[0] == rates[64] == rates[192] == pytest.approx(1.0)
    assert rates[63] < 0.06 and rates[64 + 127] < 0.06 and rates[32] == pytest.approx(0.525)


def test_objective_is_what_a_step_reports(spark):
    data = lanes(8, (60,))
    d = training.predict(frame(spark, data), start(), ["a", "b", "c"])
    got = training.objective(d, ["series"]).first()
    loss, terms = plain_loss(start(), data)
    assert got.loss == pytest.approx(loss, rel=1e-9) and all(got[t] == pytest.approx(v, rel=1e-9) for t, v in terms.items())


def plain_network(w, x):
    """The whole network of one series, row by row."""
    z = x @ w["in_w"] + w["in_b"]
    for k in range(deep.layers(w)):
        y = np.zeros_like(z)
        for t in range(len(z)):
            v = w[f"conv{k}_b"].copy()
            for j in range(5):
                if t - j * 2**k >= 0:
                    v = v + z[t - j * 2**k] @ w[f"conv{k}_w"][j]
            v = (v - v.mean()) / math.sqrt(v.var() + 1e-5)
            y[t] = [0.5 * q * (1 + math.erf(q / math.sqrt(2))) for q in v * w[f"conv{k}_scale"] + w[f"conv{k}_shift"]]
        z = y + z
    n = len(w["gate_h"])
    h, out = np.zeros(n), []
    sigmoid = lambda q: 1 / (1 + np.exp(-q))
    for t in range(len(z)):
        gx, gh = z[t] @ w["gate_x"] + w["gate_bx"], h @ w["gate_h"] + w["gate_bh"]
        r, u = sigmoid(gx[:n] + gh[:n]), sigmoid(gx[n : 2 * n] + gh[n : 2 * n])
        h = (1 - u) * np.tanh(gx[2 * n :] + r * gh[2 * n :]) + u * h
        out.append([*h, *(h @ w["head_w"] + w["head_b"])])
    return np.array(out)


def test_network_in_blocks_and_windows_is_the_unbroken_one(spark):
    data = lanes(11, (150, 64, 1))
    w = deep.init(3, 6, 3, 5, 2)
    want = {(k, i): r for k, (x, _) in data.items() for i, r in enumerate(plain_network(w, x))}
    d = frame(spark, data)

    def check(rows):
        for r in rows:
            assert np.allclose([*r.h, r.mu, r.log_sigma, r.logit], want[r.series, r.row], atol=1e-9)
        return len(rows)

    assert check(deep.forecast(d, ["a", "b", "c"], w, block=32).collect()) == 215
    # windows of 50 rows, each with the rows before it that the convolutions see, and the state that the last one left
    carry, seen = None, 0
    for k in range(3):
        z = deep.features_of(d.where(F.col("row").between(50 * k - deep.reach(w), 50 * k + 49)), ["a", "b", "c"], w, block=32)
        states = deep.recur(z.where(F.col("row") >= 50 * k), w, carry=carry)
        seen += check(states.collect())
        carry = deep.carried(states, before=carry)
    assert seen == 215
    assert {r.series for r in carry.collect()} == set(data)


def test_recurrence_keeps_its_state_where_input_is_missing(spark):
    w = deep.init(2, 4, 1, 3)
    rows = [("s", 0, [1.0, 0.5, 0.0, 2.0]), ("s", 1, None), ("s", 2, [0.0, 1.0, 1.0, 0.0])]
    got = deep.recur(spark.createDataFrame(rows, "series string, row long, z array<double>"), w).orderBy("row").collect()
    assert got[0].h == got[1].h != got[2].h
    assert deep.recur(spark.createDataFrame([], "series string, row long, z array<double>"), w).count() == 0


def test_convolution_of_columns(spark):
    data = lanes(4, (40, 3))
    taps = {"a": [0.5, -1.0, 0.25], "b": [1.0]}
    got = deep.causal_conv(frame(spark, data).drop("target"), {"y": (taps, 0.1)}, dilation=4)
    for r in got.collect():
        x = data[r.series][0]
        past = lambda i, col: x[r.row - i][col] if r.row >= i else 0.0  # noqa: E731, B023
        assert r.y == pytest.approx(0.1 + 0.5 * x[r.row][0] - past(4, 0) + 0.25 * past(8, 0) + x[r.row][1])
    assert got.count() == 43


def walk_rows(spark):
    rng = np.random.default_rng(6)
    rows = []
    for lane, n in (("x", 95), ("y", 60)):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.001, n)))
        rows += [(lane, i, 1000 + i, float(close[i]), float(rng.normal()), float(rng.normal()), i // 20) for i in range(n)]
    return spark.createDataFrame(rows, "series string, row long, ts long, close double, a double, b double, window_id long")


def walk(spark, folder, run, rate):
    out = WalkForward(spark, str(folder), run, ["a", "b"], 20, tasks=2)
    out.begin(walk_rows(spark), training.init(2, 4, 3), rate=rate)
    return out


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def close_rows(a, b):
    assert len(a) == len(b)
    for p, q in zip(a, b):
        assert [x for x in p if not isinstance(x, float)] == [x for x in q if not isinstance(x, float)]
        assert [x for x in p if isinstance(x, float)] == pytest.approx([x for x in q if isinstance(x, float)], rel=1e-9, abs=1e-12)


def test_walk_that_was_cut_off_is_the_unbroken_one(spark, tmp_path, monkeypatch):
    whole = walk(spark, tmp_path, "whole", 0.01)
    assert whole.run() == 5 and whole.step() is None
    cut = walk(spark, tmp_path, "cut", 0.01)
    assert cut.run(2) == 2
    # the third step writes all that it writes, and dies before it commits
    with monkeypatch.context() as m:
        m.setattr(WalkForward, "_commit", lambda self, state: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            cut.step()
    assert cut.tape().agg(F.max("window_id")).first()[0] == 1 and cut.metrics().agg(F.max("matured_by")).first()[0] == 1
    again = WalkForward(spark, str(tmp_path), "cut", ["a", "b"], 20, tasks=2)
    assert again.run() == 3
    with pytest.raises(ValueError):
        again.begin(walk_rows(spark))
    for part in ("tape", "metrics", "losses"):
        a, b = getattr(whole, part)(), getattr(again, part)()
        close_rows(sorted_rows(a.select(sorted(a.columns))), sorted_rows(b.select(sorted(a.columns))))
    assert np.allclose(pack(whole.weights()), pack(again.weights()), atol=1e-12)
    assert not np.allclose(pack(whole.weights()), pack(training.init(2, 4, 3)))


def test_walk_scores_only_what_has_matured(spark, tmp_path):
    """Forecasts are the weights' own, filtered over the whole lane; windows are scored once their last label has come; no label
    comes from windows ahead."""
    run = walk(spark, tmp_path, "r", 0.0)
    run.run(3)
    assert run.tape().where("target is not null").agg(F.max("row")).first()[0] == 39
    assert {(r.series, r.window_id, r.matured_by) for r in run.metrics().collect()} == {(s, k, k + 1) for s in "xy" for k in (0, 1)}
    run.run()
    assert {(r.series, r.window_id) for r in run.metrics().collect()} == {("x", 0), ("x", 1), ("x", 2), ("y", 0), ("y", 1)}
    rows = training.predict(walk_rows(spark), training.init(2, 4, 3), ["a", "b"]).orderBy("series", "row").collect()
    filters, want = {}, {}
    for r in rows:
        f = filters.setdefault(r.series, SlewFilter())
        want[r.series, r.row] = f.step(r.mu, math.exp(r.log_sigma))[0]
    got = run.tape().collect()
    assert len(got) == 155 and all(r.mu_smooth == pytest.approx(want[r.series, r.row], rel=1e-12) for r in got)
    scored = run.tape().where("target is not null").withColumn("mu", F.col("mu_smooth"))
    a = {(r.series, r.window_id): r for r in window_metrics(scored, ["series", "window_id"]).collect()}
    for r in run.metrics().collect():
        assert r.n == 20 and r.mae == pytest.approx(a[r.series, r.window_id].mae)
