"""Seeded exponential moving averages, y = (1 - a) y' + a x with a = 2 / (span + 1).

The recursion is cut into blocks of at most BLOCK rows. Inside a block it has a closed form, a windowed sum
of a x b^-j scaled by b^j; across blocks only the ends recur, one row in BLOCK, folded in order for each series with all
spans in one vector. So one long series runs on many tasks, and all spans share one layout of the rows, which the sums and
the windows both use. Blocks are shorter where a weight near one would make b^-j overflow."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 512


def alpha(span: float) -> float:
    return 2.0 / (span + 1.0)


def _fold(names):
    """Arrow group function: ends and decays of a series' blocks to the values with which its blocks start."""

    def run(table):
        table = table.sort_by("block")
        columns = lambda kind: np.stack([table.column(f"{kind}_{n}").to_numpy() for n in names], axis=1)
        ends, decays, starts = columns("end"), columns("decay"), np.empty((table.num_rows, len(names)))
        y = np.array([next((v for v in table.column(f"seed_{n}").to_pylist() if v is not None), 0.0) for n in names])
        for k in range(len(starts)):
            starts[k] = y
            y = y * decays[k] + ends[k]
        out = {"key": table.column("key"), "block": table.column("block")}
        return pa.table(out | {f"start_{n}": pa.array(starts[:, k]) for k, n in enumerate(names)})

    return run


def ema(df: DataFrame, specs: dict, key: str = "series", row: str = "row", carry: bool = False) -> DataFrame:
    """Adds a column for each name in specs: (value, span, seed), seed a number or an expression
    taken at row 0. Rows are numbered from 0 without holes in each key. A weight of 1 or more copies the
    value; one of 0 or less keeps the seed. Without carry a null or non-finite value raises; with carry such values leave the
    average as it is, and a null seed lets it begin with the first value there is."""
    names = list(specs)
    weights = {n: min(max(alpha(specs[n][1]), 0.0), 1.0) for n in names}
    plain = [n for n in names if weights[n] >= 1.0 and not carry]
    blocked = [n for n in names if n not in plain]
    d = df
    if blocked:
        keep = {n: max(1 - weights[n], 1e-300) for n in blocked}
        size = max(1, min([BLOCK, *(int(200 / -math.log10(b)) for b in keep.values() if b < 1)]))
        d = d.withColumn("block", F.floor(F.col(row) / size)).withColumn("j", (F.col(row) % size + 1).cast("double"))
        d = d.repartition(key, "block")  # values are computed behind it, so that they don't travel
    for n in names:
        x = specs[n][0].cast("double")
        missing = F.lit(None) if carry else F.raise_error(F.lit(f"{n}: a missing value; carry=True leaves the average as it is there"))
        d = d.withColumn(f"x_{n}", F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x).otherwise(missing.cast("double")))
    for n in plain:
        d = d.withColumn(n, F.col(f"x_{n}"))
    if blocked:
        inside = Window.partitionBy(key, "block").orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
        if carry:  # a row's age is the number of values in its block so far
            d = d.withColumns({f"j_{n}": F.count(f"x_{n}").over(inside).cast("double") for n in blocked})
        age = {n: F.col(f"j_{n}" if carry else "j") for n in blocked}
        term = {n: weights[n] * F.col(f"x_{n}") * F.pow(F.lit(keep[n]), -age[n]) for n in blocked}
        sums = []
        for n in blocked:
            decay = F.pow(F.lit(keep[n]), F.max(age[n]))
            seed = specs[n][2] if isinstance(specs[n][2], Column) else F.lit(float(specs[n][2]))
            seed = F.max(F.when(F.col(row) == 0, seed.cast("double")))
            if carry:  # without a seed, the first value there is
                seed = F.coalesce(seed, F.min_by(f"x_{n}", F.when(F.col(f"x_{n}").isNotNull(), F.col(row))))
            sums += [(F.coalesce(F.sum(term[n]), F.lit(0.0)) * decay).alias(f"end_{n}"), decay.alias(f"decay_{n}"), seed.alias(f"seed_{n}")]
        ends = d.groupBy(F.col(key).alias("key"), "block").agg(*sums)
        shape = ", ".join(f"start_{n} double" for n in blocked)
        kind = df.schema[key].dataType.simpleString()
        starts = ends.groupBy("key").applyInArrow(_fold(blocked), f"key {kind}, block long, {shape}")
        d = d.join(starts.withColumnRenamed("key", key), [key, "block"])
        y = {n: F.pow(F.lit(keep[n]), age[n]) * (F.coalesce(F.sum(term[n]).over(inside), F.lit(0.0)) + F.col(f"start_{n}")) for n in blocked}
        d = d.withColumns(y).drop("block", "j", *[f"start_{n}" for n in blocked], *[f"j_{n}" for n in blocked])
    return d.drop(*[f"x_{n}" for n in names])
