"""A walk forward over a run's windows that can stop anywhere and go on: each step forecasts one window of all lanes with the weights of
the step before, filters it from the state that the filter had, scores and learns the windows whose labels have matured by then, and
commits by putting a document in place."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import training
from ..operators.labels import window_metrics
from ..operators.mlp import pack, unpack
from ..operators.stability import SlewConfig, SlewFilter
from .store import RunStore


class WalkForward:
    """One run below root/run_id: input (rows by window), ends (each lane's last row in each window), tape (forecasts by window), filters (state by window and lane), metrics (scores by the
    window they belong to), steps (losses by window) and walk.json, the last whole step with its weights and the optimiser's state.

    All that a step writes lies in partitions of its window, which it replaces, and counts once walk.json names it: a step that was
    cut off is run again whole, with the same outcome. Readers of a run that goes on use `tape()` and `metrics()`, which stop at
    that step."""

    def __init__(self, spark: SparkSession, root: str, run_id: str, features: list, horizon: int, lane: str = "series", config: SlewConfig = SlewConfig(), tasks: int | None = None):
        self.spark, self.store, self.tasks = spark, RunStore(spark, root, run_id), tasks
        self.root, self.features, self.horizon, self.lane, self.config = self.store.root, features, horizon, lane, config

    def begin(self, rows: DataFrame, weights: dict | None = None, hidden: int = 32, rate: float = 2e-3) -> None:
        """Writes the input, once: lane, row (numbering a lane's rows), ts, close, features and window_id, from 0 on and of bounded size each. A rate of 0
        evaluates and learns nothing."""
        if self._state() is not None:
            raise ValueError(f"{self.root} has a run already")
        rows = rows.select(self.lane, "row", "ts", "close", *self.features, "window_id")
        self._put(rows.repartition("window_id"), "input")
        if not self._files("input"):
            raise ValueError("a run needs rows")
        self._read("input").groupBy(self.lane, "window_id").agg(F.max("row").alias("end")).write.mode("overwrite").parquet(f"{self.root}/ends")
        top = self._read("ends").agg(F.max("window_id")).first()[0]
        weights = weights or training.init(len(self.features), hidden)
        shapes = {k: list(v.shape) for k, v in weights.items()}
        self._commit({"window": -1, "windows": int(top), "rate": rate, "shapes": shapes, "weights": pack(weights).tolist(), "adam": None})

    def step(self) -> dict | None:
        """One window further; what walk.json then says, or None at the end."""
        state = self._state()
        k = state["window"] + 1
        if k > state["windows"]:
            return None
        weights = self.weights(state)
        now = self._read("input").where(F.col("window_id") == k)
        filtered = self._filtered(training.predict(now, weights, self.features), k)
        price = F.col("close") * F.exp(F.col("mu_smooth") / 1000)
        tape = filtered.withColumns({"sigma": F.exp("log_sigma"), "pred_price": price})
        self._put(tape.drop(*self.features), "tape")
        self._put(self._ends(k), "filters")
        matured = self._matured(k)
        if matured is not None:
            self._put(self._scores(matured), "metrics")
        if matured is not None and state["rate"]:
            adam = state["adam"] and {"t": state["adam"]["t"], "m": np.array(state["adam"]["m"]), "v": np.array(state["adam"]["v"])}
            weights, adam, told = training.train_in_step(matured, self.features, self.lane, "row", 1, weights, adam, rate=state["rate"], tasks=self.tasks)
            state["weights"] = pack(weights).tolist()
            state["adam"] = adam and {"t": adam["t"], "m": adam["m"].tolist(), "v": adam["v"].tolist()}
            losses = [(k, float(t["loss"]), *[float(t[c]) for c in training.TERMS]) for t in told]
            self._put(self.spark.createDataFrame(losses, "window_id long, loss double, " + ", ".join(f"{c} double" for c in training.TERMS)), "steps")
        self._commit({**state, "window": k})
        return self._state()

    def run(self, most: int | None = None) -> int:
        """Steps on from where the run stands, at most so many; how many it took."""
        taken = 0
        while (most is None or taken < most) and self.step() is not None:
            taken += 1
        return taken

    def weights(self, state: dict | None = None) -> dict:
        state = state or self._state()
        return unpack(np.array(state["weights"]), {k: np.zeros(v) for k, v in state["shapes"].items()})

    def tape(self) -> DataFrame:
        """All forecasts so far, with labels where they have come: future_price and target."""
        last = self._state()["window"]
        return self._labelled(self._read("tape").where(F.col("window_id") <= last), 0, last)

    def metrics(self) -> DataFrame:
        """Scores of the windows that have matured so far, once one has."""
        return self._read("metrics").where(F.col("matured_by") <= self._state()["window"])

    def losses(self) -> DataFrame:
        """The loss and its terms at each step that learned, once one has."""
        return self._read("steps").where(F.col("window_id") <= self._state()["window"])

    def _labelled(self, tape: DataFrame, first: int, last: int) -> DataFrame:
        """tape with the closes that stand `horizon` rows later in the windows first to last: no label comes from beyond them."""
        later = self._read("input").where(F.col("window_id").between(first, last))
        later = later.select(self.lane, (F.col("row") - self.horizon).alias("row"), F.col("close").alias("future_price"))
        target = F.when(F.col("future_price").isNotNull(), s.returns_permille(F.col("close"), F.col("future_price")))
        return tape.join(later, [self.lane, "row"], "left").withColumn("target", target)

    def _matured(self, k: int) -> DataFrame | None:
        """Rows, with features, of windows whose last label has come with window k and not before: these are scored and learned now, each
        window of a lane once. None if there are none."""
        ends = self._read("ends").where(F.col("window_id") <= k)
        now = ends.groupBy(self.lane).agg(F.max("end").alias("to"), F.max(F.when(F.col("window_id") < k, F.col("end"))).alias("was"))
        due = F.col("end") + self.horizon
        ripe = ends.join(now, self.lane).where((due <= F.col("to")) & (F.col("was").isNull() | (due > F.col("was")))).select(self.lane, "window_id")
        ids = [r.window_id for r in ripe.select("window_id").distinct().collect()]  # few; only their files are opened
        if not ids:
            return None
        own = lambda name: self._read(name).where(F.col("window_id").isin(ids))
        tape = own("tape").join(ripe, [self.lane, "window_id"])
        rows = self._labelled(tape, min(ids), k).where(F.col("target").isNotNull())
        return rows.join(own("input").select(self.lane, "row", *self.features), [self.lane, "row"]).withColumn("matured_by", F.lit(k))

    def _scores(self, matured: DataFrame) -> DataFrame:
        keys = [self.lane, "window_id", "matured_by"]
        return window_metrics(matured.withColumn("mu", F.col("mu_smooth")), keys)

    def _filtered(self, rows: DataFrame, k: int) -> DataFrame:
        """rows with mu_smooth, clipped and seen, each lane's filter going on from where the window before left it."""
        before = self._read("filters").where(F.col("window_id") == k - 1).select(self.lane, "y", "n") if k else None
        none = {"y": F.lit(None).cast("double"), "n": F.lit(None).cast("long")}
        d = rows.join(before, self.lane, "left") if k else rows.withColumns(none)
        config, names = self.config, rows.columns

        def run(table):
            table = table.sort_by("row")
            y, n = table.column("y")[0].as_py(), table.column("n")[0].as_py()
            f, out = SlewFilter(config, None if n is None else (y, n)), []
            for mu, ls in zip(table.column("mu").to_pylist(), table.column("log_sigma").to_pylist()):
                out.append((*f.step(mu, None if ls is None else float(np.exp(ls))), f.n))
            smooth, held, seen = zip(*out)
            table = table.select(names)
            for name, values, kind in (("mu_smooth", smooth, pa.float64()), ("clipped", held, pa.bool_()), ("seen", seen, pa.int64())):
                table = table.append_column(name, pa.array(values, kind))
            return table

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return d.groupBy(self.lane).applyInArrow(run, f"{kinds}, mu_smooth double, clipped boolean, seen long")

    def _ends(self, k: int) -> DataFrame:
        """Each lane's filter after window k; lanes without rows in it keep theirs."""
        last = self._read("tape").where(F.col("window_id") == k).groupBy(self.lane).agg(F.max_by(F.struct(F.col("mu_smooth").alias("y"), F.col("seen").alias("n")), "row").alias("e"))
        now = last.select(self.lane, "e.y", "e.n")
        if k:
            before = self._read("filters").where(F.col("window_id") == k - 1).select(self.lane, "y", "n")
            now = now.unionByName(before.join(now, self.lane, "left_anti"))
        return now.withColumn("window_id", F.lit(k).cast("long"))

    def _put(self, rows: DataFrame, name: str) -> None:
        """Replaces the windows that rows hold."""
        part = "matured_by" if name == "metrics" else "window_id"
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(f"{self.root}/{name}")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self._schema(name)).parquet(f"{self.root}/{name}")

    def _files(self, name: str) -> bool:
        try:
            return bool(self._schema(name))
        except AnalysisException:
            return False

    def _schema(self, name: str):
        """A table's schema, read from its files once."""
        known = self.__dict__.setdefault("_schemas", {})
        if name not in known:
            known[name] = self.spark.read.parquet(f"{self.root}/{name}").schema
        return known[name]

    def _state(self) -> dict | None:
        try:
            return json.loads(self.spark.read.text(f"{self.root}/walk.json").first().value)
        except AnalysisException:
            return None

    def _commit(self, state: dict) -> None:
        self.store.write_document("walk.json", state)
