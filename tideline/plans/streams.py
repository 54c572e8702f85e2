"""Streaming queries over replayed files; their SQL is that of the batch twins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..operators.signals import SIGNALS
from ..sources import tables
from ..streaming import replay
from . import sql
from .catalogue import H, METRIC_SQL, W, forecasts, query, rounded

PARTS = 4


def _folder(spark):
    """A new folder where all executors see it."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="tideline-")
    return f"{shared}/replay-{uuid.uuid4().hex}"


def _replayed(spark, df, key):
    path = _folder(spark)
    replay.replay_store(df, f"{path}/in", key, PARTS)
    return replay.stream(spark, f"{path}/in", df.schema), f"{path}/checkpoint"


@query(
    sql.query(
        "SELECT series, ts, round(open, 6) + 0.0 AS open, round(high, 6) + 0.0 AS high, round(low, 6) + 0.0 AS low, round(close, 6) + 0.0 AS close, round(volume, 6) + 0.0 AS volume, trades FROM bars",
        sql.TICKS,
        sql.bars(),
    )
)
def q_stream_bars(spark, sf_dir):
    s, checkpoint = _replayed(spark, tables.event_ticks(spark, sf_dir), "us")
    out = replay.drained(replay.stream_bars(s, 3600), checkpoint, "complete")
    return rounded(out, ["open", "high", "low", "close", "volume"])


@query(sql.query("SELECT series, row, round(y, 6) + 0.0 AS y FROM e", sql.BASE, sql.ema("e", [("y", "close", 60, "close")], "grid"), recursive=True))
def q_stream_ema(spark, sf_dir):
    s, checkpoint = _replayed(spark, tables.event_grid(spark, sf_dir).select("series", "row", "close"), "row")
    return rounded(replay.drained(replay.stream_ema(s, 60), checkpoint), ["y"])


@query(sql.query("SELECT series, row, round(mu_smooth, 6) + 0.0 AS mu_smooth, clipped FROM st", sql.FORECASTS, sql.stability(), recursive=True))
def q_stream_stability(spark, sf_dir):
    s, checkpoint = _replayed(spark, forecasts(spark, sf_dir).select("series", "row", "mu", "sigma"), "row")
    return rounded(replay.drained(replay.stream_stability(s), checkpoint), ["mu_smooth"])


@query(sql.query("SELECT series, row, round(close, 6) + 0.0 AS close, round(future_price, 6) + 0.0 AS future_price FROM lab WHERE future_price IS NOT NULL", sql.FORECASTS))
def q_stream_labels(spark, sf_dir):
    s, checkpoint = _replayed(spark, tables.event_grid(spark, sf_dir).select("series", "row", "close"), "row")
    return rounded(replay.drained(replay.stream_labels(s, H), checkpoint), ["close", "future_price"])


@query(sql.query(sql.signals(SIGNALS), sql.ALL, recursive=True))
def q_stream_signals(spark, sf_dir):
    s, checkpoint = _replayed(spark, tables.event_grid(spark, sf_dir), "row")
    d = replay.drained(replay.stream_signals(s, 3600), checkpoint).drop("resets")
    return d.withColumns({n: F.round(n, sql.digits(n)) + F.lit(0.0) for n in SIGNALS})


@query(sql.query(f"SELECT series, window_id, n, {METRIC_SQL} FROM wm WHERE n = {W}", sql.FORECASTS, sql.metrics("full_w")))
def q_stream_scores(spark, sf_dir):
    """Every window is scored when its last label has come."""
    rows = forecasts(spark, sf_dir).select("series", "row", "close", "mu", "sigma")
    s, checkpoint = _replayed(spark, rows, "row")
    return rounded(replay.drained(replay.stream_scores(s, H, W), checkpoint), sql.METRICS)
