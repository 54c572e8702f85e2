"""The deep forecaster's layers over rows: dilated causal convolutions in blocks that bring their history along, and a gated
recurrence whose state is a table by series, so that it carries on from window to window.

Layers normalise by row alone, never over time, so no row sees a later one."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import with_history

#: Taps of a convolution.
TAPS = 5


def causal_conv(rows: DataFrame, outputs: dict, dilation: int = 1, key: str = "series", row: str = "row") -> DataFrame:
    """rows with each output's column: bias plus the sum, over inputs and taps, of weight times the input so many dilations before; 0
    before the first row. outputs: name -> ({input: [weight of the row itself, of one dilation before, ...]}, bias). Rows are
    numbered without holes; a missing input makes outputs missing, that it reaches."""
    back = dilation * (max(len(w) for weights, _ in outputs.values() for w in weights.values()) - 1)
    inside, w, own = with_history(rows, key, row, max(back, 1))

    def tap(name, k):
        if k == 0:
            return F.col(name)
        return F.when(F.col(row) >= k * dilation, F.lag(name, k * dilation).over(w)).otherwise(0.0)

    sums = {}
    for name, (weights, bias) in outputs.items():
        sums[name] = sum((tap(i, k) * float(v) for i, taps in weights.items() for k, v in enumerate(taps)), F.lit(float(bias)))
    return inside.withColumns(sums).where(own).select(*rows.columns, *sums)


def init(n: int, channels: int = 8, layers: int = 3, hidden: int = 8, seed: int = 0) -> dict:
    """Weights: conv<k> (taps, in, out) with dilation 2^k, the gates' (input, hidden and bias, three of each: reset, update, new), the head."""
    rng = np.random.default_rng(seed)
    near = lambda *shape: rng.normal(0, 1 / math.sqrt(math.prod(shape[:-1])), shape)
    w = {"in_w": near(n, channels), "in_b": np.zeros(channels)}
    for k in range(layers):
        w |= {f"conv{k}_w": near(TAPS, channels, channels), f"conv{k}_b": np.zeros(channels), f"conv{k}_scale": np.ones(channels), f"conv{k}_shift": np.zeros(channels)}
    w |= {"gate_x": near(channels, 3 * hidden), "gate_h": near(hidden, 3 * hidden), "gate_bx": np.zeros(3 * hidden), "gate_bh": np.zeros(3 * hidden)}
    return w | {"head_w": 0.01 * near(hidden, 3), "head_b": np.array([0.0, 1.0, 0.0])}


def layers(w: dict) -> int:
    return sum(name.startswith("conv") and name.endswith("_w") for name in w)


def reach(w: dict) -> int:
    """How many rows before it an output of the convolutions sees."""
    return sum((len(w[f"conv{k}_w"]) - 1) * 2**k for k in range(layers(w)))


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.frompyfunc(math.erf, 1, 1)(x / math.sqrt(2)).astype(float))


def convolve(w: dict, x: np.ndarray) -> np.ndarray:
    """Rows of one stretch, in order, through all convolutions: each has zeros before its first row, is normalised row by row,
    bent by GELU and added to what went in."""
    z = x @ w["in_w"] + w["in_b"]
    for k in range(layers(w)):
        taps, gap = w[f"conv{k}_w"], 2**k
        y = np.tile(w[f"conv{k}_b"], (len(z), 1))
        for j, tap in enumerate(taps):
            late = min(j * gap, len(z))
            y[late:] += z[: len(z) - late] @ tap
        y = (y - y.mean(1, keepdims=True)) / np.sqrt(y.var(1, keepdims=True) + 1e-5)
        z = gelu(y * w[f"conv{k}_scale"] + w[f"conv{k}_shift"]) + z
    return z


def gated_step(w: dict, gx: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The state after one row, whose input has gone through gate_x already."""
    n = len(h)
    gh = h @ w["gate_h"] + w["gate_bh"]
    both = 1 / (1 + np.exp(-(gx[: 2 * n] + gh[: 2 * n])))
    new = np.tanh(gx[2 * n :] + both[:n] * gh[2 * n :])
    return (1 - both[n:]) * new + both[n:] * h


def features_of(rows: DataFrame, features: list, w: dict, key: str = "series", row: str = "row", block: int = 4096) -> DataFrame:
    """key, row and z, the convolutions' outputs; a missing feature is 0. Blocks run side by side, each with the rows before it that it sees: a block's
    first rows are as in the unbroken series. rows of a later window need those `reach` rows of the window before."""
    back = reach(w)
    d, _, _ = with_history(rows.select(key, row, *[F.col(c).cast("double").alias(c) for c in features]), key, row, back, block)

    def run(table):
        table = table.sort_by(row)
        x = np.stack([table.column(c).to_numpy().astype(float) for c in features], axis=1)
        z = convolve(w, np.where(np.isfinite(x), x, 0.0))
        return table.select([key, row]).append_column("z", pa.array(list(z), pa.list_(pa.float64()))).filter(table.column("own_"))

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in (key, row))
    return d.groupBy(key, "block_").applyInArrow(run, f"{kinds}, z array<double>")


def recur(inputs: DataFrame, w: dict, key: str = "series", row: str = "row", carry: DataFrame | None = None) -> DataFrame:
    """inputs (key, row, z) with h, the state after each row, and mu, log_sigma and logit. Rows are folded in order, a series in one task, batch by
    batch, so memory holds a batch and one state; series run side by side. carry: key and h, where a series goes on from (zeros for
    others). A missing z leaves the state as it is."""
    size = len(w["gate_h"])
    old = "h_before"
    if carry is None:
        d = inputs.select(key, row, "z", F.lit(None).cast("array<double>").alias(old))
    else:
        d = inputs.select(key, row, "z").join(carry.select(key, F.col("h").alias(old)), key, "left")
    d = d.repartition(key).sortWithinPartitions(key, row)

    def run(batches):
        now, h = (), None
        for batch in batches:
            keys, given = batch.column(0).to_pylist(), batch.column(3)
            z = batch.column(2)
            known = np.array(z.is_valid())
            gx = np.zeros((batch.num_rows, 3 * size))
            if known.any():
                gx[known] = np.array(z.filter(pa.array(known)).to_pylist(), float) @ w["gate_x"] + w["gate_bx"]
            states = np.empty((batch.num_rows, size))
            for i, name in enumerate(keys):
                if (name,) != now:
                    first = given[i].as_py()
                    now, h = (name,), np.zeros(size) if first is None else np.array(first)
                if known[i]:
                    h = gated_step(w, gx[i], h)
                states[i] = h
            out = states @ w["head_w"] + w["head_b"]
            told = [pa.array(list(states), pa.list_(pa.float64())), pa.array(out[:, 0]), pa.array(np.clip(out[:, 1], -4, 4)), pa.array(out[:, 2])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *told], names=[key, row, "h", "mu", "log_sigma", "logit"])

    kinds = ", ".join(f"{k} {inputs.schema[k].dataType.simpleString()}" for k in (key, row))
    return d.mapInArrow(run, f"{kinds}, h array<double>, mu double, log_sigma double, logit double")


def carried(states: DataFrame, key: str = "series", row: str = "row", before: DataFrame | None = None) -> DataFrame:
    """key and h after each series' last row; series of `before` that had no rows keep theirs."""
    now = states.groupBy(key).agg(F.max_by("h", row).alias("h"))
    return now if before is None else now.unionByName(before.join(now, key, "left_anti").select(key, "h"))


def forecast(rows: DataFrame, features: list, w: dict, key: str = "series", row: str = "row", carry: DataFrame | None = None, block: int = 4096) -> DataFrame:
    """key, row, h, mu, log_sigma and logit of rows through the whole network."""
    return recur(features_of(rows, features, w, key, row, block), w, key, row, carry)
