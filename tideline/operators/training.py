"""Training in step: barrier tasks that hold their share of the rows and exchange gradients, so that a whole training is one Spark job.

The objective has five terms: Huber errors weighted by the size of the true move, Gaussian likelihood, the direction of large moves, and first
and second differences of the forecast inside a lane. The network is the forecaster's tanh layer with three outputs: mu, log sigma, direction."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from .blocks import with_history
from .mlp import pack, unpack

#: The objective's weights, the end of the quadratic part, and the least move that counts.
TERMS = {"huber": 1.0, "nll": 0.25, "direction": 0.15, "smooth": 0.60, "curve": 0.20}
DELTA, MOVE_WEIGHT, MOVE_FLOOR = 2.0, 0.35, 0.25

#: Sums that turn a share's sums into means: rows, their moves, large moves, first and second differences.
TOTALS = ("rows", "moves", "large", "first", "second")


def init(n: int, hidden: int = 32, seed: int = 0) -> dict:
    """Weights that begin with no change and a wide band."""
    rng = np.random.default_rng(seed)
    return {"w1": rng.normal(0, 1 / np.sqrt(n), (n, hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, 0.01, (hidden, 3)), "b2": np.array([0.0, 1.0, 0.0])}


def _masks(y, own, same) -> tuple:
    """Of rows in order: those with a target that count, those of them with large moves, and those that end a difference of mu or
    of its differences. own: the row isn't history; same: it continues the row before."""
    known = own & np.isfinite(y)
    first = own & same
    return known, known & (np.abs(y) > MOVE_FLOOR), first, first & np.concatenate([[False], same[:-1]])


def share_totals(y, own, same) -> np.ndarray:
    known, large, first, second = _masks(y, own, same)
    return np.array([known.sum(), np.abs(y[known]).sum(), large.sum(), first.sum(), second.sum()], float)


def share_gradient(w: dict, x, y, own, same, totals) -> tuple:
    """One share's part of the five terms and of the gradient: the parts of all shares add up to the whole's."""
    n, n_large, n_first, n_second = (max(1.0, totals[k]) for k in (0, 2, 3, 4))
    known, large, first, second = _masks(y, own, same)
    h = np.tanh(x @ w["w1"] + w["b1"])
    mu, raw, logit = (h @ w["w2"] + w["b2"]).T
    ls = np.clip(raw, -4, 4)
    t = np.where(known, y, 0.0)
    e = np.where(known, mu - t, 0.0)
    a, inv = np.abs(e), np.exp(-2 * ls)
    weight = known * (1 + MOVE_WEIGHT * np.abs(t) / (MOVE_FLOOR + totals[1] / n + 1e-6))
    up = (t > 0).astype(float)
    d1 = np.concatenate([[0.0], np.diff(mu)]) * first
    # a difference of differences needs mu of the two rows before, be they history or not
    d2 = np.zeros_like(mu)
    d2[2:] = (mu[2:] - 2 * mu[1:-1] + mu[:-2]) * second[2:]
    terms = np.array([
        (np.where(a <= DELTA, 0.5 * e * e, DELTA * (a - 0.5 * DELTA)) * weight).sum() / n,
        ((0.5 * e * e * inv + ls) * known).sum() / n,
        ((np.logaddexp(0, logit) - logit * up) * large).sum() / n_large,
        (d1 * d1).sum() / n_first,
        (d2 * d2).sum() / n_second,
    ])
    g_mu = np.clip(e, -DELTA, DELTA) * weight / n + TERMS["nll"] * e * inv / n
    g1, g2 = 2 * TERMS["smooth"] * d1 / n_first, 2 * TERMS["curve"] * d2 / n_second
    g_mu += g1 + g2
    g_mu[:-1] -= g1[1:] + 2 * g2[1:]
    g_mu[:-2] += g2[2:]
    g_ls = TERMS["nll"] * (1 - e * e * inv) * known / n * (np.abs(raw) < 4)
    g_dir = TERMS["direction"] * (1 / (1 + np.exp(-logit)) - up) * large / n_large
    g = np.stack([g_mu, g_ls, g_dir], axis=1)
    back = (g @ w["w2"].T) * (1 - h * h)
    return terms, {"w1": x.T @ back, "b1": back.sum(0), "w2": h.T @ g, "b2": g.sum(0)}


class AdamW:
    """Adam with decay of the weights beside the gradient, along cosines that restart, each twice as long as the one before."""

    #: averages' factors, decay, the first cosine's steps, the least share of the rate.
    BETAS, DECAY, FIRST, LEAST = (0.9, 0.98), 1e-4, 64, 0.05

    def __init__(self, rate: float = 2e-3, clip: float = 1.0, state: dict | None = None):
        self.rate, self.clip = rate, clip
        self.s = state or {"t": 0, "m": 0.0, "v": 0.0}

    def now(self) -> float:
        """The rate of the next step."""
        at, length = self.s["t"], self.FIRST
        while at >= length:
            at, length = at - length, 2 * length
        return self.rate * (self.LEAST + (1 - self.LEAST) * (1 + np.cos(np.pi * at / length)) / 2)

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        rate, (b1, b2) = self.now(), self.BETAS
        g = g * min(1.0, self.clip / (np.linalg.norm(g) + 1e-12))
        t = self.s["t"] + 1
        m, v = b1 * self.s["m"] + (1 - b1) * g, b2 * self.s["v"] + (1 - b2) * g * g
        self.s = {"t": t, "m": m, "v": v}
        return w * (1 - rate * self.DECAY) - rate * (m / (1 - b1**t)) / (np.sqrt(v / (1 - b2**t)) + 1e-8)


def _summed(context, values: np.ndarray) -> np.ndarray:
    """The sum over all tasks, added in the tasks' order, so that every task has the same to the last bit."""
    parts = context.allGather(base64.b64encode(values.astype("<f8").tobytes()).decode())
    return np.sum([np.frombuffer(base64.b64decode(p), "<f8") for p in parts], axis=0)


def _learner(start, state, features, lane, order, steps, rate):
    """Arrow mapper of one barrier task: reads its share once, takes all steps with the others; the first tells the outcome."""

    def run(batches):
        context = BarrierTaskContext.get()
        batches = [b for b in batches if b.num_rows]
        table = pa.Table.from_batches(batches) if batches else None
        if table is None:
            x, y = np.zeros((0, len(features))), np.zeros(0)
            own = same = np.zeros(0, bool)
        else:
            # the share comes sorted by lane, block and order
            x = np.stack([table.column(c).to_numpy().astype(float) for c in features], axis=1)
            x = np.where(np.isfinite(x), x, 0.0)
            y = table.column("target").to_numpy().astype(float)
            own = table.column("own_").to_numpy().astype(bool)
            at = table.column(order).to_numpy()
            names, blocks = table.column(lane).combine_chunks(), table.column("block_").to_numpy()
            group = names.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            same = np.concatenate([[False], (group[1:] == group[:-1]) & (blocks[1:] == blocks[:-1]) & (at[1:] == at[:-1] + 1)])
        totals = _summed(context, share_totals(y, own, same))
        w, adam, told = start, AdamW(rate, state=state), []
        for k in range(steps if totals.any() else 0):
            terms, g = share_gradient(w, x, y, own, same, totals)
            both = _summed(context, np.concatenate([terms, pack(g)]))
            now = adam.now()
            w = unpack(adam.step(pack(w), both[5:]), w)
            told.append((k, float(np.dot(both[:5], list(TERMS.values()))), *both[:5].tolist(), float(now)))
        if context.partitionId() == 0 and told:
            size = len(pack(w))
            last = lambda v: [None] * (steps - 1) + [np.broadcast_to(v, size).tolist()]
            columns = [pa.array(c) for c in zip(*told)] + [pa.array(last(v), pa.list_(pa.float64())) for v in (pack(w), adam.s["m"], adam.s["v"])]
            yield pa.RecordBatch.from_arrays(columns, names=["step", "loss", *TERMS, "rate", "weights", "m", "v"])

    return run


OUT = "step long, loss double, " + ", ".join(f"{t} double" for t in TERMS) + ", rate double, weights array<double>, m array<double>, v array<double>"


def train_in_step(
    rows: DataFrame, features: list, lane: str, order: str, steps: int = 10, start: dict | None = None, state: dict | None = None,
    hidden: int = 32, rate: float = 2e-3, tasks: int | None = None, block: int = 4096,
) -> tuple:
    """(weights, optimiser's state, [{step, loss, the five terms, rate}]) after steps over all rows.

    rows: features, target, lane and order, which numbers a lane's rows; where numbers are missing, differences don't cross the hole.
    Blocks of a lane, each with the two rows before it, lie on `tasks` barrier tasks (all that run at once, if not given, and no more may be
    asked for); each holds its share, rows / tasks, in memory, and only sums as long as the weights travel. A missing target counts in
    differences alone, a missing feature is 0; where there is nothing to count, no
    step is taken. If an executor is lost, Spark runs the stage again from its
    start, with the same outcome: steps between two calls are what a run can lose, so long runs go by `start` and `state` from one call to the next."""
    spark = rows.sparkSession
    tasks = tasks or spark.sparkContext.defaultParallelism
    start = start or init(len(features), hidden)
    # missing targets as NaN, so that the column has no nulls in numpy
    data = rows.select(lane, order, *[F.col(c).cast("double").alias(c) for c in features], F.coalesce(F.col("target").cast("double"), F.lit(float("nan"))).alias("target"))
    data, _, _ = with_history(data, lane, order, 2, block)
    data = data.repartition(tasks, lane, "block_").sortWithinPartitions(lane, "block_", order)
    out = data.mapInArrow(_learner(start, state, features, lane, order, steps, rate), OUT, barrier=True).collect()  # sorted here: a sort in Spark would sample, and so train twice
    if not out:
        return start, state, []
    out = sorted(out, key=lambda r: r.step)
    last = out[-1]
    after = {"t": (state["t"] if state else 0) + steps, "m": np.array(last["m"]), "v": np.array(last["v"])}
    return unpack(np.array(last["weights"]), start), after, [{c: r[c] for c in ("step", "loss", *TERMS, "rate")} for r in out]


def objective(rows: DataFrame, keys: list, order: str = "row") -> DataFrame:
    """The five terms and the loss of mu, log_sigma and logit against target, for each key's rows: what one step over them would report. Rows
    without a target count in differences alone."""
    c = F.col
    w = Window.partitionBy(*keys).orderBy(order)
    y, ls = c("target"), s.clip(c("log_sigma"), -4, 4)
    d = rows.withColumn("d1", c("mu") - F.lag("mu").over(w))
    d = d.withColumn("d2", c("d1") - F.lag("d1").over(w))
    # the weight of a move needs the mean move: sums of both parts of the weighted error stand side by side
    e = c("mu") - y
    huber = F.when(F.abs(e) <= DELTA, 0.5 * e * e).otherwise(DELTA * (F.abs(e) - 0.5 * DELTA))
    large = F.abs(y) > MOVE_FLOOR
    cross = F.greatest(c("logit"), F.lit(0.0)) + F.log1p(F.exp(-F.abs(c("logit")))) - c("logit") * (y > 0).cast("double")
    zero = F.lit(0.0)
    out = d.groupBy(*keys).agg(
        F.count(y).alias("n"),
        (F.avg(huber) + MOVE_WEIGHT * F.avg(huber * F.abs(y)) / (MOVE_FLOOR + F.avg(F.abs(y)) + 1e-6)).alias("huber"),
        F.avg(F.when(y.isNotNull(), ls + 0.5 * e * e * F.exp(-2 * ls))).alias("nll"),
        F.coalesce(F.avg(F.when(large, cross)), zero).alias("direction"),
        F.coalesce(F.avg(c("d1") * c("d1")), zero).alias("smooth"),
        F.coalesce(F.avg(c("d2") * c("d2")), zero).alias("curve"),
    )
    return out.withColumn("loss", sum((F.coalesce(c(t), zero) * k for t, k in TERMS.items()), zero))


def predict(rows: DataFrame, w: dict, features: list) -> DataFrame:
    """Adds mu, log_sigma and logit; a missing feature is 0."""

    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in features], axis=1)
            o = np.tanh(np.where(np.isfinite(x), x, 0.0) @ w["w1"] + w["b1"]) @ w["w2"] + w["b2"]
            told = [pa.array(o[:, 0]), pa.array(np.clip(o[:, 1], -4, 4)), pa.array(o[:, 2])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *told], names=[*batch.schema.names, "mu", "log_sigma", "logit"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, mu double, log_sigma double, logit double")
