"""Running normaliser: moments of a sample of each window, folded over windows in order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLOOR, EPS, CLIP, MOMENTUM, EVERY = 1e-8, 1e-6, 8.0, 1e-4, 17


def normalise(rows: DataFrame, columns: list, size: int, observe_first: bool = False, momentum: float = MOMENTUM) -> DataFrame:
    """Adds z_<column>. Each window is normalised by moments up to the window before, or, with
    observe_first, by those that hold its own sample (every EVERY-th row) already.

    Nulls of a column are left out of its moments, each counted by itself; a window that has no value leaves them as they
    are. Windows are pre-aggregated; only a row for each window is folded in order. series may be of any type that groups."""
    d = rows.withColumn("window_id", F.floor(F.col("row") / size).cast("long"))
    sums = []
    for c in columns:
        sums += [F.count(c).alias(f"n_{c}"), F.avg(c).alias(f"m_{c}"), F.var_pop(c).alias(f"v_{c}")]
    sample = d.where((F.col("row") % size) % EVERY == 0).groupBy("series", "window_id").agg(*sums)

    def fold(table):
        table = table.sort_by("window_id")
        out = {"series": table.column("series"), "window_id": table.column("window_id")}
        for c in columns:
            mean, var, means, variances = 0.0, 1.0, [], []
            for k, m, v in zip(table.column(f"n_{c}").to_pylist(), table.column(f"m_{c}").to_pylist(), table.column(f"v_{c}").to_pylist()):
                before = (mean, var)
                if m is not None:
                    w = min(1.0, momentum * k)
                    mean = (1 - w) * mean + w * m
                    var = (1 - w) * var + w * max(v, FLOOR)
                use = (mean, var) if observe_first else before
                means.append(use[0])
                variances.append(use[1])
            out |= {f"mean_{c}": pa.array(means, pa.float64()), f"var_{c}": pa.array(variances, pa.float64())}
        return pa.table(out)

    shape = ", ".join(f"mean_{c} double, var_{c} double" for c in columns)
    kind = rows.schema["series"].dataType.simpleString()
    told = sample.groupBy("series").applyInArrow(fold, f"series {kind}, window_id long, {shape}")
    z = {}
    for c in columns:
        x = (F.col(c) - F.col(f"mean_{c}")) / F.sqrt(F.col(f"var_{c}") + EPS)
        z[f"z_{c}"] = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(-CLIP)), F.lit(CLIP)))
    d = d.join(told, ["series", "window_id"]).withColumns(z)
    return d.drop(*[f"{p}_{c}" for c in columns for p in ("mean", "var")])
