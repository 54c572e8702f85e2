"""The forecaster's network: features and their moving contexts, one tanh layer, mean and log sigma. Contexts are averages
over the whole series, so they carry from window to window; smoothness counts inside a lane alone, so seams between lanes don't.

Training is a driver loop over steps; each step's gradient is summed over lanes on the executors, so data
stay where they are and only weights and gradients, of fixed size, travel. Prediction is one Arrow pass."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ema import ema

#: Loss weights.
HUBER, NLL_WEIGHT, SMOOTH_WEIGHT = 2.0, 0.25, 0.6


#: Spans of the contexts.
CONTEXTS = (15, 120, 900)


def with_contexts(rows: DataFrame, features: list, key: str = "series", row: str = "row", spans=CONTEXTS) -> tuple:
    """rows with <feature>_ctx<span>, each feature's moving averages from its first value on, and all names: what the network reads."""
    names = {f"{f}_ctx{n}": (F.col(f), n, F.col(f)) for n in spans for f in features}
    return ema(rows, names, key, row), [*features, *names]


def init(n: int, hidden: int = 32, seed: int = 0) -> dict:
    rng = np.random.default_rng(seed)
    return {"w1": rng.normal(0, 1 / np.sqrt(n), (n, hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, 0.05, (hidden, 2)), "b2": np.zeros(2)}


def forward(w: dict, x: np.ndarray):
    h = np.tanh(x @ w["w1"] + w["b1"])
    o = h @ w["w2"] + w["b2"]
    return h, o[:, 0], np.clip(o[:, 1], -4, 4)


def gradient(w: dict, x: np.ndarray, y: np.ndarray) -> tuple:
    """Summed loss and gradients of one lane's rows, in order."""
    h, mu, ls = forward(w, x)
    e = mu - y
    a, inv = np.abs(e), np.exp(-2 * ls)
    huber = np.where(a <= HUBER, 0.5 * e * e, HUBER * (a - 0.5 * HUBER))
    loss = (huber + NLL_WEIGHT * (0.5 * e * e * inv + ls)).sum()
    g_mu = np.clip(e, -HUBER, HUBER) + NLL_WEIGHT * e * inv
    d = np.diff(mu)
    loss += SMOOTH_WEIGHT * (d * d).sum()
    g_mu[1:] += 2 * SMOOTH_WEIGHT * d
    g_mu[:-1] -= 2 * SMOOTH_WEIGHT * d
    g = np.stack([g_mu, NLL_WEIGHT * (1 - e * e * inv)], axis=1)
    back = (g @ w["w2"].T) * (1 - h * h)
    return loss, {"w1": x.T @ back, "b1": back.sum(0), "w2": h.T @ g, "b2": g.sum(0)}


def pack(w: dict) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def unpack(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


class Adam:
    def __init__(self, rate=3e-3, clip=1.0):
        self.rate, self.clip, self.m, self.v, self.t = rate, clip, 0.0, 0.0, 0

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        g = g * min(1.0, self.clip / (np.linalg.norm(g) + 1e-12))
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        return w - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def train(rows: DataFrame, features: list, lane: str, order: str, steps: int = 10, hidden: int = 32, rate: float = 3e-3) -> tuple:
    """Weights, and the mean loss at each step. rows: features, target, lane, order."""
    w, adam, losses = init(len(features), hidden), Adam(rate), []

    def lane_gradient(now):
        def run(table):
            table = table.sort_by(order)
            x = np.stack([table.column(c).to_numpy() for c in features], axis=1).astype(float)
            loss, g = gradient(now, x, table.column("target").to_numpy().astype(float))
            return pa.table({"loss": [float(loss)], "n": [len(x)], "g": pa.array([pack(g).tolist()], pa.list_(pa.float64()))})

        return run

    data = rows.select(lane, order, "target", *features).repartition(lane).persist()  # read in every step
    for _ in range(steps):
        parts = data.groupBy(lane).applyInArrow(lane_gradient(w), "loss double, n long, g array<double>")
        # added up place by place on the executors: what comes back is as long as the weights
        values = F.concat(F.array("loss", F.col("n").cast("double")), F.col("g"))
        total = parts.select(F.posexplode(values).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).orderBy("at")
        total = np.array([r.x for r in total.collect()] or [0.0] * (2 + len(pack(w))))
        n = max(1.0, total[1])
        losses.append(total[0] / n)
        flat = adam.step(pack(w), total[2:] / n)
        w = unpack(flat, w)
    data.unpersist()
    return w, losses


def predict(rows: DataFrame, w: dict, features: list) -> DataFrame:
    """Adds mu and log_sigma."""

    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in features], axis=1).astype(float)
            _, mu, ls = forward(w, x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mu), pa.array(ls)], names=[*batch.schema.names, "mu", "log_sigma"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*rows.schema.fields, StructField("mu", DoubleType()), StructField("log_sigma", DoubleType())])
    return rows.mapInArrow(run, schema)
