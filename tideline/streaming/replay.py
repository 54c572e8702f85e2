"""Structured Streaming twins of the batch operators, over a replayed bar store.

Each takes a stream of rows and gives a streaming DataFrame; the batch code's classes do the arithmetic, so
stream and batch agree. State is keyed by series and kept in the state store: checkpoints restore
offsets and state together. Rows of a micro-batch are sorted by time before they are used."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ema import alpha
from ..operators.online import OnlineSignals, score_window
from ..operators.signals import SIGNALS
from ..operators.stability import SlewConfig, SlewFilter
from ..sources.store import put_document

SCORES = (
    "n", "mae", "rmse", "mape_pct", "band_accuracy", "direction_acc", "r2", "skill_vs_naive", "reward", "bias", "jitter", "max_slew",
    "sigma_mean", "calibration",
)


def replay_store(df: DataFrame, path: str, key: str, parts: int) -> str:
    """Writes df as `parts` files in the order of key, one folder each, for a replay in time order."""
    ends = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    step = max(1, -(-(ends.hi - ends.lo + 1) // parts))
    for k in range(parts):
        lo = ends.lo + k * step
        df.where((F.col(key) >= lo) & (F.col(key) < lo + step)).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """Bars as they were written: `files` a micro-batch. With availableNow the replay is unpaced; a
    processing-time trigger paces it."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("latestFirst", "false").parquet(path)


def stream_bars(ticks: DataFrame, seconds: int, late: str = "1 hour") -> DataFrame:
    """OHLCV by event time; in append mode a cell comes out when the watermark passes it, in complete mode at
    once. ticks: series, us, id, price, volume."""
    t = ticks.withColumn("at", F.timestamp_micros("us")).withWatermark("at", late)
    first = F.struct("us", "id")
    return t.groupBy("series", F.window("at", f"{seconds} seconds").alias("w")).agg(
        F.min_by("price", first).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", first).alias("close"),
        F.sum("volume").alias("volume"), F.count("*").alias("trades"),
    ).select("series", F.unix_timestamp("w.start").alias("ts"), "open", "high", "low", "close", "volume", "trades")


def _stateful(rows: DataFrame, out: str, state: str, step, order: str = "row") -> DataFrame:
    """step(sorted rows, state tuple or None) -> (result rows, state tuple), for each series."""

    def run(key, batches, group: GroupState):
        frame = pd.concat(list(batches)).sort_values(order)
        result, kept = step(key[0], frame, group.get if group.exists else None)
        group.update(kept)
        yield result

    return rows.groupBy("series").applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def stream_ema(rows: DataFrame, span: float) -> DataFrame:
    """series, row, y: the moving average of close, seeded by the first close."""
    a = alpha(span)

    def step(series, frame, state):
        y = state[0] if state else None
        out = []
        for x in frame["close"].tolist():
            y = x if y is None else (1 - a) * y + a * x
            out.append(y)
        return pd.DataFrame({"series": series, "row": frame["row"], "y": out}), (y,)

    return _stateful(rows, "series string, row long, y double", "y double", step)


def stream_stability(rows: DataFrame, config: SlewConfig = SlewConfig()) -> DataFrame:
    """series, row, mu_smooth, clipped for rows with mu and sigma."""

    def step(series, frame, state):
        f = SlewFilter(config, state)
        got = [f.step(mu, sigma) for mu, sigma in zip(frame["mu"].tolist(), frame["sigma"].tolist())]
        return pd.DataFrame({"series": series, "row": frame["row"], "mu_smooth": pd.array([g[0] for g in got], "Float64"), "clipped": [g[1] for g in got]}), f.state()

    return _stateful(rows, "series string, row long, mu_smooth double, clipped boolean", "y double, n long", step)


def stream_labels(rows: DataFrame, horizon: int) -> DataFrame:
    """series, row, close, future_price: a row comes out when the row `horizon` later arrives. Pending rows are
    the state, at most horizon of them."""

    def step(series, frame, state):
        rows_, closes = (list(state[0]), list(state[1])) if state else ([], [])
        pending, out = dict(zip(rows_, closes)), []
        for r, c in zip(frame["row"].tolist(), frame["close"].tolist()):
            pending[r] = c
            if (old := pending.pop(r - horizon, None)) is not None:
                out.append((series, r - horizon, old, c))
        result = pd.DataFrame(out, columns=["series", "row", "close", "future_price"])
        return result, (list(pending), list(pending.values()))

    return _stateful(rows, "series string, row long, close double, future_price double", "rows array<long>, closes array<double>", step)


def stream_signals(rows: DataFrame, seconds: int) -> DataFrame:
    """series, ts, resets and the forty signals of gridded bars. The engine's state is kept for each series; a
    discontinuity begins it anew and adds to resets."""

    def step(series, frame, state):
        engine = OnlineSignals(seconds, state[0] if state else None)
        got = [[b["ts"], *engine.update([b])[0], engine.resets] for b in frame.to_dict("records")]
        out = pd.DataFrame(got, columns=["ts", *SIGNALS, "resets"])
        out.insert(0, "series", series)
        return out[["series", "ts", "resets", *SIGNALS]], (engine.state(),)

    names = ", ".join(f"{n} double" for n in SIGNALS)
    return _stateful(rows, f"series string, ts long, resets int, {names}", "engine string", step, "ts")


def stream_scores(rows: DataFrame, horizon: int, size: int) -> DataFrame:
    """series, window_id and the scores of each tumbling window of `size` rows, once its last label is there. rows:
    series, row, close, mu, sigma. The state holds the rows that wait, at most horizon + size; rows after a hole
    in the numbering begin anew, and what waits before it is dropped."""

    def step(series, frame, state):
        wait = json.loads(state[0]) if state else []
        out, rows_ = [], [r for r in frame[["row", "close", "mu", "sigma"]].values.tolist()]
        for r in rows_:
            if wait and r[0] != wait[-1][0] + 1:
                wait = []
            wait.append(r)
            last = int(r[0]) - horizon  # the row whose label this is
            if last >= 0 and (last + 1) % size == 0 and wait[0][0] <= last + 1 - size:
                first = last + 1 - size
                own = [w for w in wait if first <= w[0] <= last]
                later = {w[0]: w[1] for w in wait if w[0] > first}
                target = [1000 * (math.log(max(later[w[0] + horizon], 1e-12)) - math.log(max(w[1], 1e-12))) for w in own]
                out.append({"series": series, "window_id": last // size, **score_window([w[1] for w in own], [w[2] for w in own], [w[3] for w in own], target)})
                wait = [w for w in wait if w[0] > last]
        return pd.DataFrame(out, columns=["series", "window_id", *SCORES]), (json.dumps(wait),)

    names = ", ".join(f"{n} {'long' if n == 'n' else 'double'}" for n in SCORES)
    return _stateful(rows, f"series string, window_id long, {names}", "wait string", step)


def drained(df: DataFrame, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, into a table beside its checkpoint, and reads that. Appended rows are
    committed exactly once; in complete mode each micro-batch replaces the table."""
    path = f"{checkpoint}-table"
    if mode == "append":
        q = into_table(df, path, checkpoint)
    else:
        write = lambda batch, k: batch.write.mode("overwrite").parquet(path)
        q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def into_table(df: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Exactly-once append of matured rows to a Parquet table: of all that is there, or, paced, a micro-batch
    every so often (such as "1 second") until stopped."""
    out = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def live_state(df: DataFrame, path: str, checkpoint: str, most: int = 600, every: str | None = None):
    """Keeps one JSON document, a file at path: of each series, the newest `most` rows, its rolling buffer. df: series, ts and
    values, streamed; readers poll the file, and find the last version or the one before it, whole.

    The document names the stream and micro-batch that wrote it: one that comes again, after a failure, changes nothing. A row whose
    (series, ts) the buffer has takes the older one's place."""
    rest = [c for c in df.columns if c != "series"]
    kinds = ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.select(*rest).schema.fields)
    fields = f"series string, points array<struct<{kinds}>>, stream string, batch long"

    def write(batch, k):
        spark = batch.sparkSession
        try:
            document = spark.read.schema(fields).json(path)
        except AnalysisException:  # the first micro-batch
            document = spark.createDataFrame([], fields)
        if document.where((F.col("stream") == checkpoint) & (F.col("batch") >= k)).limit(1).count():
            return
        held = document.selectExpr("series", "inline(points)").withColumn("age", F.lit(1))
        last = Window.partitionBy("series", "ts").orderBy("age")
        rows = held.unionByName(batch.withColumn("age", F.lit(0))).withColumn("k", F.row_number().over(last)).where("k = 1")
        newest = Window.partitionBy("series").orderBy(F.desc("ts"))
        rows = rows.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= most)
        points = F.sort_array(F.collect_list(F.struct("ts", *[c for c in rest if c != "ts"])))
        told = rows.groupBy("series").agg(points.alias("points"))
        put_document(told.withColumn("stream", F.lit(checkpoint)).withColumn("batch", F.lit(k).cast("long")), path)

    out = df.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()
