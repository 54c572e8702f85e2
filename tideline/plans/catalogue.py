"""The query catalogue over the driver's tables: a Spark plan and its DuckDB twin for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import codec, grid, labels, mlp, stability, views, windows
from ..operators.ema import ema
from ..operators.normalise import normalise
from ..operators.signals import SIGNALS, returns, signals
from ..sources import tables
from ..sources.store import named_windows
from . import sql

G, W, H = 3600, 24, 24
QUERIES, ORACLES = {}, {}


def query(oracle: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def rounded(df: DataFrame, columns, digits: int = 6) -> DataFrame:
    """Columns rounded, and without negative zeros."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in columns})


BAR_COLUMNS = ("open", "high", "low", "close", "volume", "quote_volume", "taker_buy_base")
BAR_SQL = sql.rounded(BAR_COLUMNS)


@query(sql.query(f"SELECT series, ts, {BAR_SQL}, trades FROM bars", sql.TICKS, sql.bars()))
def q_ohlcv_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tables.event_bars(spark, sf_dir, G), BAR_COLUMNS)


@query(sql.query(f"SELECT series, ts, row, {BAR_SQL}, CAST(trades AS BIGINT) AS trades, gap FROM grid", sql.BASE))
def q_grid_ffill(spark, sf_dir):
    return rounded(tables.event_grid(spark, sf_dir), BAR_COLUMNS)


GLOBAL = """ticks1 AS (SELECT id, 'all' AS series, us, price, volume, taker FROM ticks)"""


@query(
    sql.query(
        f"SELECT ts, row, {BAR_SQL}, CAST(trades AS BIGINT) AS trades, gap FROM grid", sql.TICKS, GLOBAL, sql.bars(60, "ticks1"), sql.grid(60)
    )
)
def q_grid_minutes(spark, sf_dir):
    ticks = tables.event_ticks(spark, sf_dir).withColumn("series", F.lit("all"))
    out = grid.on_grid(grid.bars_from_ticks(ticks, 60), 60)
    return rounded(out, BAR_COLUMNS).drop("series")


LO, HI = 1704412800, 1705017600


@query(sql.query(f"SELECT series, ts, round(close, 6) + 0.0 AS close FROM bars WHERE ts >= {LO} AND ts < {HI}", sql.TICKS, sql.bars()))
def q_range_scan(spark, sf_dir):
    out = tables.time_range(tables.event_bars(spark, sf_dir, G), LO, HI)
    return rounded(out.select("series", "ts", "close"), ["close"])


@query(sql.query(f"SELECT series, ts, round(close, 6) + 0.0 AS close FROM bars WHERE ts >= {LO} - 48 * 3600 AND ts < {LO}", sql.TICKS, sql.bars()))
def q_history_before(spark, sf_dir):
    out = tables.history_before(tables.event_bars(spark, sf_dir, G), LO, 48, G)
    return rounded(out.select("series", "ts", "close"), ["close"])


CHUNKS = """chunks AS (SELECT series, strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') AS chunk, min(ts) AS t0, count(*) AS n FROM grid GROUP BY 1, 2)"""


@query(sql.query("SELECT * FROM chunks", sql.BASE, CHUNKS))
def q_chunk_catalogue(spark, sf_dir):
    return tables.catalogue(tables.event_grid(spark, sf_dir))


@query(
    sql.query(
        "SELECT series, count(*) AS n_chunks, CAST(sum(n) AS BIGINT) AS n_cells, min(t0) AS t_start, max(t0 + n * 3600) AS t_end, median(n) AS median_n, round(sum(n) / 24.0, 6) AS days FROM chunks GROUP BY 1",
        sql.BASE,
        CHUNKS,
    )
)
def q_catalogue_describe(spark, sf_dir):
    c = tables.catalogue(tables.event_grid(spark, sf_dir))
    return c.groupBy("series").agg(
        F.count("*").alias("n_chunks"), F.sum("n").alias("n_cells"), F.min("t0").alias("t_start"), F.max(F.col("t0") + F.col("n") * G).alias("t_end"),
        F.median("n").alias("median_n"), F.round(F.sum("n") / 24.0, 6).alias("days"),
    )


@query(
    sql.query(
        "SELECT k, series, chunk FROM chunks JOIN rng ON t0 < hi AND t0 + n * 3600 > lo",
        sql.BASE,
        CHUNKS,
        f"rng AS (SELECT k, {LO} + k * 100000 AS lo, {LO} + k * 100000 + 150000 AS hi FROM range(5) t(k))",
    )
)
def q_chunk_overlap(spark, sf_dir):
    r = spark.range(5).select(F.col("id").alias("k"), (F.lit(LO) + F.col("id") * 100000).alias("lo"), (F.lit(LO + 150000) + F.col("id") * 100000).alias("hi"))
    return tables.overlapping(tables.catalogue(tables.event_grid(spark, sf_dir)), r, G).select("k", "series", "chunk")


MONTHS_SQL = """SELECT strftime(d, '%Y-%m') AS month, CAST(epoch(d) AS BIGINT) AS lo, CAST(epoch(d + INTERVAL 1 MONTH) AS BIGINT) AS hi
FROM (SELECT unnest(generate_series(TIMESTAMP '2017-08-01', TIMESTAMP '2026-10-01', INTERVAL 1 MONTH)) AS d)"""


@query(MONTHS_SQL)
def q_months(spark, sf_dir):
    return tables.months(spark, "2017-08", "2026-10")


CODED = """c0 AS (SELECT *, CAST(round_even(close * 100, 0) AS BIGINT) AS cc,
    CASE WHEN volume > 0 THEN quote_volume / greatest(volume, 1e-12) ELSE close END AS vw,
    CASE WHEN volume > 0 THEN least(greatest(taker_buy_base / greatest(volume, 1e-12), 0), 1) ELSE 0.5 END AS ra FROM grid),
coded AS (SELECT series, ts, row, CAST(cc - coalesce(lag(cc) OVER (PARTITION BY series, row // 100 ORDER BY row), 0) AS INT) AS close_delta,
  CAST(round_even(open * 100, 0) - cc AS INT) AS open_off, CAST(round_even(high * 100, 0) - cc AS INT) AS high_off, CAST(round_even(low * 100, 0) - cc AS INT) AS low_off,
  CAST(round_even((vw - cc / 100.0::DOUBLE) * 100, 0) AS BIGINT) AS vwap_off, CAST(round_even(volume * 10000, 0) AS INT) AS volume_i,
  CAST(least(trades, 65535) AS INT) AS trades_u16, CAST(round_even(ra * 255, 0) AS INT) AS tb_ratio_u8, gap FROM c0)"""


@query(sql.query("SELECT * FROM coded", sql.BASE, CODED))
def q_codec_encode(spark, sf_dir):
    return codec.encode(tables.event_grid(spark, sf_dir), 100)


DECODED = """dec AS (SELECT *, sum(close_delta) OVER (PARTITION BY series, row // 100 ORDER BY row) AS c, volume_i / 10000.0::DOUBLE AS v FROM coded)"""


@query(
    sql.query(
        """SELECT series, ts, row, round((c + open_off) / 100.0, 6)::DOUBLE AS open, round((c + high_off) / 100.0, 6)::DOUBLE AS high, round((c + low_off) / 100.0, 6)::DOUBLE AS low,
  round(c / 100.0, 6)::DOUBLE AS close, round(v, 6) + 0.0 AS volume, round(v * (c / 100.0::DOUBLE + vwap_off / 100.0::DOUBLE), 4) AS quote_volume,
  CAST(trades_u16 AS BIGINT) AS trades, round(v * tb_ratio_u8 / 255, 6) AS taker_buy_base, gap FROM dec""",
        sql.BASE,
        CODED,
        DECODED,
    )
)
def q_codec_roundtrip(spark, sf_dir):
    out = codec.decode(codec.encode(tables.event_grid(spark, sf_dir), 100), 100)
    return rounded(rounded(out, [c for c in BAR_COLUMNS if c != "quote_volume"]), ["quote_volume"], 4)


@query(
    sql.query(
        """SELECT series, count(*) AS n_bars, count(*) FILTER (NOT close > 0) AS bad_closes, count(*) FILTER (low > least(open, close) OR high < greatest(open, close)) AS bad_ohlc,
  count(*) FILTER (gap AND volume > 0) AS gap_with_volume, count(*) FILTER (step <> 3600) AS breaks, min(low) AS min_price, max(high) AS max_price, round(avg(CAST(gap AS INT)), 6) AS gap_ratio
FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY series ORDER BY ts) AS step FROM grid) GROUP BY 1""",
        sql.BASE,
    )
)
def q_quality(spark, sf_dir):
    return grid.quality(tables.event_grid(spark, sf_dir), G)


ROW_NAMES = ("vol_range", "flow_vwap_dev", "flow_notional")
CLOCKS = tuple(n for n in SIGNALS if n.startswith("clock_"))
LAGGED = tuple(n for n in SIGNALS if n.startswith("mom_ret"))
PLAIN = f"{sql.BASE}, {sql.RETURNS}, {sql.INPUTS}, s AS (SELECT * FROM inp)"


def signal_query(name, names, plain=False):
    def run(spark, sf_dir):
        d = signals(tables.event_grid(spark, sf_dir), names=names).select("series", "ts", *names)
        return d.withColumns({n: F.round(n, sql.digits(n)) + F.lit(0.0) for n in names})

    run.__name__ = name
    query(sql.query(sql.signals(names), PLAIN if plain else sql.ALL, recursive=not plain))(run)


signal_query("q_row_signals", ROW_NAMES, True)
signal_query("q_clock", CLOCKS, True)
signal_query("q_lag_returns", LAGGED, True)
signal_query("q_accel", ("mom_ret1", "mom_accel"), True)
signal_query("q_trend", tuple(n for n in SIGNALS if n.startswith("trend_ema")))
signal_query("q_macd", ("trend_macd", "trend_macd_sig", "trend_macd_hist", "trend_slope"))
signal_query("q_rsi", ("mom_rsi",))
signal_query("q_realised_vol", ("vol_rv60", "vol_rv300", "vol_rv1800", "vol_range_ema"))
signal_query("q_vol_of_vol", ("vol_of_vol",))
signal_query("q_flow", ("flow_vol_z60", "flow_vol_z900", "flow_trades_z60", "flow_trades_z900"))
signal_query("q_imbalance", ("flow_imbalance_fast", "flow_imbalance_slow"))
signal_query("q_gap_density", ("micro_gap_density",))
signal_query("q_band_pos", ("micro_band_pos",))
signal_query("q_signals_all", SIGNALS)

LITERAL = ", ".join(
    f"round((lp - coalesce({'lp' if n == 1 else f'lag(lp, {n - 1}) OVER w'}, first_value(lp) OVER w)) * 1e3, 6) AS mom_ret{n}" for n in (1, 5, 15, 60)
)


@query(sql.query(f"SELECT series, ts, {LITERAL} FROM (SELECT *, ln(greatest(close, 1e-12)) AS lp FROM grid) WINDOW w AS (PARTITION BY series ORDER BY row)", sql.BASE))
def q_lag_returns_literal(spark, sf_dir):
    """Returns with one row less of lag."""
    names = [f"mom_ret{n}" for n in (1, 5, 15, 60)]
    return rounded(returns(tables.event_grid(spark, sf_dir), (1, 5, 15, 60), 1).select("series", "ts", *names), names)


@query(
    sql.query(
        "SELECT series, ts, round(y20, 6) + 0.0 AS y20, round(y300, 6) + 0.0 AS y300 FROM e",
        sql.BASE,
        sql.ema("e", [("y20", "close", 20, "0.0"), ("y300", "close", 300, "close")], "grid"),
        recursive=True,
    )
)
def q_ema(spark, sf_dir):
    out = ema(tables.event_grid(spark, sf_dir), {"y20": (F.col("close"), 20, 0.0), "y300": (F.col("close"), 300, F.col("close"))})
    return rounded(out.select("series", "ts", "y20", "y300"), ["y20", "y300"])


@query(
    sql.query(
        "SELECT ts, round(y60, 6) + 0.0 AS y60, round(y7200, 6) + 0.0 AS y7200 FROM e",
        sql.TICKS,
        GLOBAL,
        sql.bars(60, "ticks1"),
        sql.grid(60),
        sql.ema("e", [("y60", "close", 60, "close"), ("y7200", "close", 7200, "close")], "grid"),
        recursive=True,
    )
)
def q_ema_minutes(spark, sf_dir):
    """One long series: its blocks run in parallel."""
    ticks = tables.event_ticks(spark, sf_dir).withColumn("series", F.lit("all"))
    bars = grid.on_grid(grid.bars_from_ticks(ticks, 60), 60)
    out = ema(bars, {"y60": (F.col("close"), 60, F.col("close")), "y7200": (F.col("close"), 7200, F.col("close"))})
    return rounded(out.select("ts", "y60", "y7200"), ["y60", "y7200"])


def norm_sql(observe_first):
    use = ("mean", "var") if observe_first else ("mean0", "var0")
    return sql.query(
        f"""SELECT r.series, r.ts, round(least(greatest((r.mom_ret1 - f.{use[0]}) / sqrt(f.{use[1]} + 1e-6), -8.0), 8.0), 6) AS z_mom_ret1 FROM rets r JOIN f ON f.series = r.series AND f.k = r.row // 24""",
        sql.BASE,
        sql.RETURNS,
        "sm AS (SELECT series, row // 24 AS k, avg(mom_ret1) AS m, var_pop(mom_ret1) AS v, least(1.0, 1e-4 * count(*)) AS w FROM rets WHERE (row % 24) % 17 = 0 GROUP BY 1, 2)",
        """f AS (SELECT series, k, 0.0::DOUBLE AS mean0, 1.0::DOUBLE AS var0, (w * m)::DOUBLE AS mean, ((1 - w) + w * greatest(v, 1e-8))::DOUBLE AS var FROM sm WHERE k = 0
  UNION ALL SELECT s.series, s.k, f.mean, f.var, (1 - s.w) * f.mean + s.w * s.m, (1 - s.w) * f.var + s.w * greatest(s.v, 1e-8) FROM f JOIN sm s ON s.series = f.series AND s.k = f.k + 1)""",
        recursive=True,
    )


@query(norm_sql(False))
def q_normalise(spark, sf_dir):
    out = normalise(returns(tables.event_grid(spark, sf_dir)), ["mom_ret1"], W)
    return rounded(out.select("series", "ts", "z_mom_ret1"), ["z_mom_ret1"])


@query(norm_sql(True))
def q_normalise_observe_first(spark, sf_dir):
    out = normalise(returns(tables.event_grid(spark, sf_dir)), ["mom_ret1"], W, observe_first=True)
    return rounded(out.select("series", "ts", "z_mom_ret1"), ["z_mom_ret1"])


FULL_GRID = """fw AS (SELECT g.*, row // 24 AS window_id FROM grid g JOIN (SELECT series, max(row) + 1 AS n FROM grid GROUP BY 1) USING (series) WHERE (row // 24 + 1) * 24 <= n)"""


@query(sql.query("SELECT series, window_id, min(ts) AS t0, max(ts) AS t1, count(*) AS n FROM fw GROUP BY 1, 2", sql.BASE, FULL_GRID))
def q_tumbling_full(spark, sf_dir):
    d = windows.full_windows(tables.event_grid(spark, sf_dir), W)
    return d.groupBy("series", "window_id").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.count("*").alias("n"))


@query(sql.query("SELECT series, window_id, round(avg(close), 6) AS close FROM fw WHERE window_id % 3 = 0 GROUP BY 1, 2", sql.BASE, FULL_GRID))
def q_tumbling_stride(spark, sf_dir):
    d = windows.full_windows(tables.event_grid(spark, sf_dir), W, 3)
    return d.groupBy("series", "window_id").agg(F.round(F.avg("close"), 6).alias("close"))


@query(
    sql.query(
        "SELECT series, ts, CAST(sum(j) OVER (PARTITION BY series ORDER BY ts) AS BIGINT) AS epoch FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY series ORDER BY ts) <> 3600 THEN 1 ELSE 0 END AS j FROM bars)",
        sql.TICKS,
        sql.bars(),
    )
)
def q_epochs(spark, sf_dir):
    return windows.epochs(tables.event_bars(spark, sf_dir, G), G).select("series", "ts", "epoch")


def forecasts(spark, sf_dir):
    d = returns(tables.event_grid(spark, sf_dir), (1, 5, 15))
    c = F.col
    return d.select(
        "series", "row", "ts", "close", labels.linear({"mom_ret1": 0.02, "mom_ret5": -0.01, "mom_ret15": 0.005}).alias("mu"),
        (0.5 + 0.001 * F.abs(c("mom_ret1"))).alias("sigma"), (0.1 + 0.0005 * F.abs(c("mom_ret5"))).alias("log_sigma"), windows.window_id(W).alias("window_id"),
    )


def labelled(spark, sf_dir):
    return labels.with_labels(forecasts(spark, sf_dir), H)


def scored_rows(d):
    last = d.groupBy("series").agg((F.max("row") + 1).alias("n"))
    return d.join(last, "series").where(((F.col("window_id") + 1) * W <= F.col("n")) & F.col("target").isNotNull()).drop("n")


@query(sql.query("SELECT series, ts, round(future_price, 6) + 0.0 AS future_price, round(target, 6) + 0.0 AS target FROM lab", sql.FORECASTS))
def q_label_join(spark, sf_dir):
    return rounded(labelled(spark, sf_dir).select("series", "ts", "future_price", "target"), ["future_price", "target"])


@query(
    sql.query(
        "SELECT series, ts, ts + 86400 AS target_ts, round(close * exp(mu / 1000), 6) AS pred_price, round(close * (exp(sigma / 1000) - 1), 6) AS band, round(abs(close * exp(mu / 1000) - future_price) / future_price * 10000, 4) AS err_bps FROM lab",
        sql.FORECASTS,
    )
)
def q_project_price(spark, sf_dir):
    d = labelled(spark, sf_dir).withColumn("p", s.price_after(F.col("close"), F.col("mu")))
    return d.select(
        "series", "ts", (F.col("ts") + H * G).alias("target_ts"), F.round("p", 6).alias("pred_price"), F.round(s.sigma_price(F.col("close"), F.col("sigma")), 6).alias("band"),
        F.round(s.error_bps(F.col("p"), F.col("future_price")), 4).alias("err_bps"),
    )


METRIC_SQL = sql.rounded(sql.METRICS)


@query(sql.query(f"SELECT series, window_id, n, {METRIC_SQL} FROM wm", sql.FORECASTS, sql.metrics("full_w")))
def q_window_metrics(spark, sf_dir):
    return rounded(labels.window_metrics(scored_rows(labelled(spark, sf_dir)), ["series", "window_id"]), sql.METRICS)


RUN_INPUT = "wr AS (SELECT series, window_id AS row, mae, direction_acc FROM wm)"


@query(
    sql.query(
        """SELECT series, row AS window_id, round(ema_mae, 6) + 0.0 AS ema_mae, round(ema_direction, 6) + 0.0 AS ema_direction,
  round(min(ema_mae) OVER w, 6) AS best_ema_mae, round(max(ema_direction) OVER w, 6) AS best_ema_direction FROM e WINDOW w AS (PARTITION BY series ORDER BY row)""",
        sql.FORECASTS,
        sql.metrics("full_w"),
        RUN_INPUT,
        sql.ema("e", [("ema_mae", "mae", 20, "mae"), ("ema_direction", "direction_acc", 20, "direction_acc")], "wr"),
        recursive=True,
    )
)
def q_running_metrics(spark, sf_dir):
    m = labels.window_metrics(scored_rows(labelled(spark, sf_dir)), ["series", "window_id"]).withColumn("row", F.col("window_id"))
    d = ema(m, {"ema_mae": (F.col("mae"), 20, F.col("mae")), "ema_direction": (F.col("direction_acc"), 20, F.col("direction_acc"))})
    d = labels.running_best(d, ["ema_direction"], ["ema_mae"], "series", "row")
    names = ["ema_mae", "ema_direction", "best_ema_mae", "best_ema_direction"]
    return rounded(d.select("series", "window_id", *names), names)


@query(sql.query(f"SELECT window_id, count(*) AS lanes, {', '.join(f'round(avg({c}), 6) AS {c}' for c in ('mae', 'band_accuracy', 'skill_vs_naive'))} FROM wm GROUP BY 1", sql.FORECASTS, sql.metrics("full_w")))
def q_lane_mean(spark, sf_dir):
    m = labels.window_metrics(scored_rows(labelled(spark, sf_dir)), ["series", "window_id"])
    return m.groupBy("window_id").agg(F.count("*").alias("lanes"), *[F.round(F.avg(c), 6).alias(c) for c in ("mae", "band_accuracy", "skill_vs_naive")])


@query(sql.query("SELECT series, ts, round(mu_smooth, 6) + 0.0 AS mu_smooth, clipped FROM st", sql.FORECASTS, sql.stability(), recursive=True))
def q_stability(spark, sf_dir):
    f = forecasts(spark, sf_dir)
    d = f.select("series", "row", "ts").join(stability.stabilise(f, ["series"]), ["series", "row"])
    return rounded(d.select("series", "ts", "mu_smooth", "clipped"), ["mu_smooth"])


@query(sql.query("SELECT series, ts, round(mu_smooth, 6) + 0.0 AS mu_smooth, clipped FROM st", sql.FORECASTS, sql.stability(), recursive=True))
def q_stability_blocks(spark, sf_dir):
    """The filter of blocks side by side; short ones, so that some begin with a wrong guess and run again."""
    f = forecasts(spark, sf_dir)
    d = f.select("series", "row", "ts").join(stability.stabilise_long(f, ["series"], block=256, lead=64), ["series", "row"])
    return rounded(d.select("series", "ts", "mu_smooth", "clipped"), ["mu_smooth"])


REPORT = """SELECT series, round(coalesce(avg(d), 0.0), 6) AS jitter, round(coalesce(max(d), 0.0), 6) AS max_slew, round(coalesce(avg(CASE WHEN d IS NULL THEN NULL WHEN d > 0.08 THEN 1.0 ELSE 0.0 END), 0.0), 6) AS breaches, count(*) AS n
FROM (SELECT *, abs(mu - lag(mu) OVER (PARTITION BY series ORDER BY row)) AS d FROM fc) GROUP BY 1"""


@query(sql.query(REPORT, sql.FORECASTS))
def q_stability_report(spark, sf_dir):
    return rounded(stability.stability_report(forecasts(spark, sf_dir), ["series"], "mu"), ["jitter", "max_slew", "breaches"])


@query(
    sql.query(
        "SELECT series, round(CASE WHEN avg(a) > 0 THEN 1 - avg(b) / avg(a) ELSE 0.0 END, 6) AS gain, round(avg(CASE WHEN clipped THEN 1.0 ELSE 0.0 END), 6) AS clipped_share FROM (SELECT *, abs(mu - lag(mu) OVER w) AS a, abs(mu_smooth - lag(mu_smooth) OVER w) AS b FROM st WINDOW w AS (PARTITION BY series ORDER BY row)) GROUP BY 1",
        sql.FORECASTS,
        sql.stability(),
        recursive=True,
    )
)
def q_smoothness_gain(spark, sf_dir):
    f = forecasts(spark, sf_dir)
    d = f.select("series", "row", "mu").join(stability.stabilise(f, ["series"]), ["series", "row"])
    share = d.groupBy("series").agg(F.round(F.avg(F.col("clipped").cast("double")), 6).alias("clipped_share"))
    return rounded(stability.smoothness_gain(d, ["series"], "mu", "mu_smooth"), ["gain"]).join(share, "series")


def replay(spark, sf_dir):
    """Bars to signals, forecast, filter, price, label and score: the whole held-out replay."""
    f = forecasts(spark, sf_dir)
    d = f.join(stability.stabilise(f, ["series"]), ["series", "row"]).drop("mu").withColumnRenamed("mu_smooth", "mu")
    return labels.window_metrics(scored_rows(labels.with_labels(d, H)), ["series", "window_id"])


@query(
    sql.query(
        f"SELECT series, window_id, n, {METRIC_SQL} FROM wm",
        sql.FORECASTS,
        sql.stability("full0", "st"),
        sql.metrics("(SELECT st.* FROM st JOIN full_w USING (series, row))", "mu_smooth"),
        recursive=True,
    ).replace("full_w AS (", "full0 AS (SELECT * FROM lab), full_w AS (", 1)
)
def q_replay(spark, sf_dir):
    return rounded(replay(spark, sf_dir), sql.METRICS)


@query(sql.query("SELECT series, CASE WHEN ts < cut THEN 'train' ELSE 'eval' END AS part, count(*) AS n, min(ts) AS t0 FROM grid JOIN (SELECT series, c - c % 86400 AS cut FROM (SELECT series, max(ts) + 3600 - CAST(floor((max(ts) + 3600 - min(ts)) * 0.05) AS BIGINT) AS c FROM grid GROUP BY 1)) USING (series) GROUP BY 1, 2", sql.BASE))
def q_split(spark, sf_dir):
    d = windows.split_eval(tables.event_grid(spark, sf_dir), 0.05, W, G)
    return d.groupBy("series", "part").agg(F.count("*").alias("n"), F.min("ts").alias("t0"))


LANES = """SELECT series, lane, count(*) AS n, min(ts) AS t0 FROM (
  SELECT series, ts, n, seg, cnt, CASE WHEN n < 48 THEN 0 ELSE CAST(row // seg AS INT) END AS lane FROM grid JOIN (
    SELECT series, n, CASE WHEN s0 < 96 THEN greatest(1, n // 96) ELSE 4 END AS cnt,
      CASE WHEN s0 < 96 THEN greatest(48, n // greatest(1, n // 96) - (n // greatest(1, n // 96)) % 24) ELSE s0 END AS seg
    FROM (SELECT series, max(row) + 1 AS n, (max(row) + 1) // 4 - ((max(row) + 1) // 4) % 24 AS s0 FROM grid GROUP BY 1)) USING (series))
WHERE n < 48 OR (lane < cnt AND least(n, (lane + 1) * seg) - lane * seg >= 48) GROUP BY 1, 2"""


@query(sql.query(LANES, sql.BASE))
def q_lanes(spark, sf_dir):
    d = windows.lanes(tables.event_grid(spark, sf_dir), 4, W)
    return d.groupBy("series", "lane").agg(F.count("*").alias("n"), F.min("ts").alias("t0"))


@query(sql.query("SELECT series, CAST((window_id // 8) % 3 AS INT) AS rank, count(*) AS n FROM fw GROUP BY 1, 2", sql.BASE, FULL_GRID))
def q_shards(spark, sf_dir):
    d = windows.round_robin(windows.full_windows(tables.event_grid(spark, sf_dir), W), 3, 8)
    return d.groupBy("series", "rank").agg(F.count("*").alias("n"))


@query(sql.query("SELECT series, ts, round(close, 6) + 0.0 AS close FROM grid WHERE row % 8 = 0", sql.BASE))
def q_thin(spark, sf_dir):
    return rounded(windows.thin(tables.event_grid(spark, sf_dir), 8).select("series", "ts", "close"), ["close"])


@query(sql.query("SELECT series, ts, window_id FROM (SELECT *, max(window_id) OVER (PARTITION BY series) AS top FROM fw) WHERE window_id > top - 3", sql.BASE, FULL_GRID))
def q_last_n(spark, sf_dir):
    d = windows.newest_windows(windows.full_windows(tables.event_grid(spark, sf_dir), W), 3)
    return d.select("series", "ts", "window_id")


@query(sql.query("SELECT series, window_id, round(mae, 6) + 0.0 AS mae FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY mae, window_id) AS k FROM wm) WHERE k <= 5", sql.FORECASTS, sql.metrics("full_w")))
def q_topk(spark, sf_dir):
    m = labels.window_metrics(scored_rows(labelled(spark, sf_dir)), ["series", "window_id"])
    w = Window.partitionBy("series").orderBy("mae", "window_id")
    return rounded(m.withColumn("k", F.row_number().over(w)).where("k <= 5").select("series", "window_id", "mae"), ["mae"])


@query(
    sql.query(
        "SELECT series, window_id, round(arg_min(mae, (abs(window_id - mw), mw)), 6) AS nearest_mae FROM (SELECT DISTINCT series, window_id FROM fw) JOIN (SELECT series AS ms, window_id AS mw, mae FROM wm WHERE window_id % 4 = 1) ON ms = series GROUP BY 1, 2",
        sql.FORECASTS,
        FULL_GRID,
        sql.metrics("full_w"),
    )
)
def q_nearest_metrics(spark, sf_dir):
    m = labels.window_metrics(scored_rows(labelled(spark, sf_dir)), ["series", "window_id"]).where("window_id % 4 = 1")
    w = windows.full_windows(tables.event_grid(spark, sf_dir), W).select("series", "window_id").distinct()
    return rounded(windows.nearest(w, m, "series", "window_id", "mae"), ["nearest_mae"])


@query(
    sql.query(
        "SELECT series AS run_id, round(avg(band_accuracy), 6) AS band_10bps, round(avg(direction_acc), 6) AS direction, round(avg(skill_vs_naive), 6) AS skill, round(avg(jitter), 6) AS jitter, count(*) AS windows FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY window_id DESC) AS k FROM wm) WHERE k <= 20 GROUP BY 1",
        sql.FORECASTS,
        sql.metrics("full_w"),
    )
)
def q_report_latest(spark, sf_dir):
    metrics = labels.window_metrics(scored_rows(labelled(spark, sf_dir)), ["series", "window_id"])
    return spark.sql(
        """SELECT series AS run_id, round(avg(band_accuracy), 6) AS band_10bps, round(avg(direction_acc), 6) AS direction, round(avg(skill_vs_naive), 6) AS skill,
             round(avg(jitter), 6) AS jitter, count(*) AS windows
           FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY window_id DESC) AS k FROM {metrics}) WHERE k <= 20 GROUP BY series""",
        metrics=metrics,
    )


@query(
    sql.query(
        "SELECT ts, round(close, 6) + 0.0 AS price_now, round(close * exp(mu / 1000), 6) AS pred_price, round(future_price, 6) + 0.0 AS true_future_price, round(abs(close * exp(mu / 1000) - future_price) / future_price * 10000, 4) AS err_bps FROM lab WHERE series = (SELECT max(series) FROM lab) ORDER BY ts LIMIT 20000",
        sql.FORECASTS,
    )
)
def q_actual_vs_pred(spark, sf_dir):
    return spark.sql(
        """SELECT ts, round(close, 6) + 0.0 AS price_now, round(close * exp(mu / 1000), 6) AS pred_price, round(future_price, 6) + 0.0 AS true_future_price,
             round(abs(close * exp(mu / 1000) - future_price) / future_price * 10000, 4) AS err_bps
           FROM {tape} WHERE series = (SELECT max(series) FROM {tape}) ORDER BY ts LIMIT 20000""",
        tape=labelled(spark, sf_dir),
    )


@query(sql.query("SELECT series, round(quantile_cont(mom_ret1, 0.01), 6) AS p1, round(quantile_cont(mom_ret1, 0.99), 6) AS p99 FROM rets GROUP BY 1", sql.BASE, sql.RETURNS))
def q_quantiles(spark, sf_dir):
    d = returns(tables.event_grid(spark, sf_dir), (1,)).groupBy("series").agg(F.percentile("mom_ret1", F.array(F.lit(0.01), F.lit(0.99))).alias("q"))
    return rounded(d.select("series", F.col("q")[0].alias("p1"), F.col("q")[1].alias("p99")), ["p1", "p99"])


PARTS = """parts AS (SELECT *, 0 AS part FROM bars WHERE ts < 1705276800 UNION ALL SELECT series, ts, open + 1, high + 1, low + 1, close + 1, volume, quote_volume, trades, taker_buy_base, 1 FROM bars WHERE ts >= 1705190400 AND ts < 1706000000),
merged AS (SELECT * EXCLUDE (part, k) FROM (SELECT *, row_number() OVER (PARTITION BY series, ts ORDER BY part DESC) AS k FROM parts) WHERE k = 1)"""


@query(sql.query(f"SELECT series, ts, row, {BAR_SQL}, CAST(trades AS BIGINT) AS trades, gap FROM g2", sql.TICKS, sql.bars(), PARTS, sql.grid(3600, "merged", "g2")))
def q_concat_parts(spark, sf_dir):
    b = tables.event_bars(spark, sf_dir, G)
    later = b.where((F.col("ts") >= 1705190400) & (F.col("ts") < 1706000000)).withColumns({c: F.col(c) + 1 for c in grid.PRICES})
    return rounded(grid.concat_parts([b.where(F.col("ts") < 1705276800), later], G), BAR_COLUMNS)


@query(
    sql.query(
        "SELECT series, ts, round(mu, 6) + 0.0 AS mu, round(CASE WHEN row % 2 = 0 THEN target END, 6) AS target FROM lab",
        sql.FORECASTS,
    )
)
def q_consolidate(spark, sf_dir):
    """Tape files with and without labels in one table: missing columns are null."""
    d = labelled(spark, sf_dir)
    some, none = d.where("row % 2 = 0").select("series", "ts", "mu", "target"), d.where("row % 2 = 1").select("series", "ts", "mu")
    return rounded(some.unionByName(none, allowMissingColumns=True), ["mu", "target"])


@query(sql.query("SELECT chunk, series FROM chunks WHERE chunk NOT IN (SELECT chunk FROM chunks WHERE substr(chunk, 10, 1) IN ('1', '3', '5'))", sql.BASE, CHUNKS))
def q_resume_anti(spark, sf_dir):
    c = tables.catalogue(tables.event_grid(spark, sf_dir))
    done = c.where(F.substring("chunk", 10, 1).isin("1", "3", "5")).select("chunk").distinct()
    return c.join(done, "chunk", "left_anti").select("chunk", "series")


LOSS = """SELECT series, window_id, round(avg(CASE WHEN abs(e) <= 2 THEN 0.5 * e * e ELSE 2 * (abs(e) - 1) END), 6) AS huber, round(avg(ls + 0.5 * e * e * exp(-2 * ls)), 6) AS nll, round(avg(d1 * d1), 6) AS smooth, round(avg(d2 * d2), 6) AS curve
FROM (SELECT *, d1 - lag(d1) OVER w AS d2 FROM (SELECT *, mu - target AS e, least(greatest(log_sigma, -4), 4) AS ls, mu - lag(mu) OVER v AS d1 FROM full_w WINDOW v AS (PARTITION BY series, window_id ORDER BY row)) WINDOW w AS (PARTITION BY series, window_id ORDER BY row)) GROUP BY 1, 2"""


@query(sql.query(LOSS, sql.FORECASTS))
def q_loss_terms(spark, sf_dir):
    names = ["huber", "nll", "smooth", "curve"]
    return rounded(labels.loss_terms(scored_rows(labelled(spark, sf_dir)), ["series", "window_id"]), names)


@query(sql.query("SELECT series, ts, round(mu, 6) + 0.0 AS mu, round(sigma, 6) + 0.0 AS sigma FROM fc", sql.FORECASTS))
def q_linear_forecast(spark, sf_dir):
    return rounded(forecasts(spark, sf_dir).select("series", "ts", "mu", "sigma"), ["mu", "sigma"])


@query(
    sql.query(
        "SELECT series, window_id, n, repeat('#', n) || repeat('-', 24 - n) AS bar FROM (SELECT series, window_id, CAST(round_even(least(greatest(direction_acc, 0), 1) * 24, 0) AS INT) AS n FROM wm)",
        sql.FORECASTS,
        sql.metrics("full_w"),
    )
)
def q_bars_text(spark, sf_dir):
    m = labels.window_metrics(scored_rows(labelled(spark, sf_dir)), ["series", "window_id"])
    frac = s.progress(F.col("direction_acc"))
    return m.select("series", "window_id", F.bround(frac * 24, 0).cast("int").alias("n"), s.text_bar(frac).alias("bar"))


DAILY = """SELECT series, day, round(arg_min(price, k), 6) AS open, round(max(price), 6) AS high, round(min(price), 6) AS low, round(arg_max(price, k), 6) AS close, count(*) AS trades
FROM (SELECT o_orderpriority AS series, CAST(epoch(o_orderdate) AS BIGINT) // 86400 AS day, o_orderkey AS k, o_totalprice AS price FROM orders) GROUP BY 1, 2"""


@query(DAILY)
def q_order_bars(spark, sf_dir):
    """A second series: daily bars of order prices."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    t = o.select(F.col("o_orderpriority").alias("series"), (F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86_400_000_000) * 86_400_000_000).cast("long").alias("us"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.lit(1.0).alias("volume"), F.lit(0.0).alias("taker"))
    d = grid.bars_from_ticks(t, 86400)
    return rounded(d.select("series", F.floor(F.col("ts") / 86400).alias("day"), *grid.PRICES, "trades"), grid.PRICES)


VIEW = """SELECT series, ts, round(close, 6) + 0.0 AS close, ts + 86400 AS due_ts, round(close * exp(mu / 1000), 6) + 0.0 AS pred_price,
  round(close * exp(mu / 1000) - close * (exp(sigma / 1000) - 1), 6) + 0.0 AS lo, round(close * exp(mu / 1000) + close * (exp(sigma / 1000) - 1), 6) + 0.0 AS hi,
  round(mu - target, 6) + 0.0 AS error_permille FROM (SELECT *, max(row) OVER (PARTITION BY series) AS top FROM lab) WHERE row > top - 72"""


@query(sql.query(VIEW, sql.FORECASTS))
def q_view_trailing(spark, sf_dir):
    return rounded(views.trailing(labelled(spark, sf_dir), 72, H * G), ["close", "pred_price", "lo", "hi", "error_permille"])


@query(
    sql.query(
        "SELECT series, row AS window_id, round(mae, 6) + 0.0 AS mae, round(ema_mae, 6) + 0.0 AS ema_mae, round(lo, 6) + 0.0 AS lo_mae, round(hi, 6) + 0.0 AS hi_mae FROM e JOIN (SELECT series, quantile_cont(mae, 0.01) AS lo, quantile_cont(mae, 0.99) AS hi FROM wr GROUP BY 1) USING (series)",
        sql.FORECASTS,
        sql.metrics("full_w"),
        RUN_INPUT,
        sql.ema("e", [("ema_mae", "mae", 40, "mae")], "wr"),
        recursive=True,
    )
)
def q_metric_curves(spark, sf_dir):
    m = labels.window_metrics(scored_rows(labelled(spark, sf_dir)), ["series", "window_id"]).withColumnRenamed("window_id", "row")
    names = ["mae", "ema_mae", "lo_mae", "hi_mae"]
    return rounded(views.curves(m, ["mae"]).withColumnRenamed("row", "window_id"), names).select("series", "window_id", *names)


THINNED = "thin AS (SELECT series, ts, round(close, 2) AS close FROM grid JOIN (SELECT series, count(*) AS n FROM grid GROUP BY 1) USING (series) WHERE row % CAST(greatest(1, ceil(n / 100.0)) AS BIGINT) = 0)"


@query(sql.query("""SELECT series, '[' || string_agg('{"ts":' || ts || ',"close":' || CAST(close AS VARCHAR) || '}', ',' ORDER BY ts) || ']' AS points, count(*) AS n_points FROM thin GROUP BY 1""", sql.BASE, THINNED))
def q_payload(spark, sf_dir):
    return views.payload(rounded(tables.event_grid(spark, sf_dir), ["close"], 2), ["close"], 100)


@query(sql.query("SELECT series, ts, row, round(open, 6) + 0.0 AS open, round(close, 6) + 0.0 AS close, round(volume, 6) + 0.0 AS volume, round(trades, 6) + 0.0 AS trades FROM grid WHERE row >= 10 AND row < 40", sql.BASE))
def q_feature_matrix(spark, sf_dir):
    m = tables.row_slice(tables.feature_matrix(tables.event_grid(spark, sf_dir)), 10, 40)
    x = lambda k, name: F.get("x", F.lit(k)).alias(name)
    return rounded(m.select("series", "ts", "row", x(0, "open"), x(3, "close"), x(4, "volume"), x(6, "trades")), ["open", "close", "volume", "trades"])


WARM = "grid0 AS (SELECT * FROM grid), warm AS (SELECT * EXCLUDE (row), (ts - min(ts) OVER (PARTITION BY series)) // 3600 AS row FROM grid0 WHERE ts >= 1705017600 - 120 * 3600)"


@query(
    sql.query(
        "SELECT series, ts, round(y60, 6) + 0.0 AS y60, round(y300, 6) + 0.0 AS y300 FROM e WHERE ts >= 1705017600",
        sql.BASE,
        WARM,
        sql.ema("e", [("y60", "close", 60, "close"), ("y300", "close", 300, "close")], "warm"),
        recursive=True,
    )
)
def q_prewarm(spark, sf_dir):
    """Averages from a moment on, begun 120 cells before it."""
    specs = {"y60": (F.col("close"), 60, F.col("close")), "y300": (F.col("close"), 300, F.col("close"))}
    out = tables.prewarmed(tables.event_grid(spark, sf_dir), HI, G, lambda d: ema(d, specs), 120)
    return rounded(out.select("series", "ts", "y60", "y300"), ["y60", "y300"])


BEST = {"band_accuracy": "max", "direction_acc": "max", "skill_vs_naive": "max", "r2": "max", "reward": "max", "mae": "min", "rmse": "min", "jitter": "min", "mape_pct": "min"}
SKIPS = "wr AS (SELECT series, window_id AS row, " + ", ".join(f"CASE WHEN (window_id + {k}) % 5 = 0 THEN NULL ELSE {n} END AS {n}" for k, n in enumerate(BEST)) + " FROM wm)"
_A20 = "2.0::DOUBLE / 21"
SKIPPING = "e AS (SELECT series, row, {} FROM wr WHERE row = 0 UNION ALL SELECT i.series, i.row, {} FROM e JOIN wr i ON i.series = e.series AND i.row = e.row + 1)".format(
    ", ".join(f"{n}::DOUBLE AS {n}" for n in BEST),
    ", ".join(f"CASE WHEN i.{n} IS NULL THEN e.{n} WHEN e.{n} IS NULL THEN i.{n} ELSE (1 - {_A20}) * e.{n} + {_A20} * i.{n} END" for n in BEST),
)


@query(
    sql.query(
        "SELECT series, row AS window_id, "
        + ", ".join(f"round({n}, 6) + 0.0 AS ema_{n}, round({f}({n}) OVER w, 6) + 0.0 AS best_{n}" for n, f in BEST.items())
        + " FROM e WINDOW w AS (PARTITION BY series ORDER BY row)",
        sql.FORECASTS,
        sql.metrics("full_w"),
        SKIPS,
        SKIPPING,
        recursive=True,
    )
)
def q_running_best(spark, sf_dir):
    """Averages that skip missing values, and the best of each of nine metrics."""
    m = labels.window_metrics(scored_rows(labelled(spark, sf_dir)), ["series", "window_id"]).withColumn("row", F.col("window_id"))
    m = m.select("series", "row", *[F.when((F.col("row") + k) % 5 != 0, F.col(n)).alias(n) for k, n in enumerate(BEST)])
    low = [n for n, f in BEST.items() if f == "min"]
    d = labels.running_metrics(m, list(BEST), high=[n for n in BEST if n not in low], low=low)
    names = [f"{p}_{n}" for n in BEST for p in ("ema", "best")]
    return rounded(d.withColumnRenamed("row", "window_id"), names)


@query(
    sql.query(
        "SELECT series, round(coalesce(avg(b), 0.0), 6) + 0.0 AS jitter, round(coalesce(max(b), 0.0), 6) + 0.0 AS max_slew, round(avg(CASE WHEN clipped THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS clipped_share, round(coalesce(avg(a), 0.0), 6) + 0.0 AS raw_jitter FROM (SELECT *, abs(mu - lag(mu) OVER w) AS a, abs(mu_smooth - lag(mu_smooth) OVER w) AS b FROM st WINDOW w AS (PARTITION BY series ORDER BY row)) GROUP BY 1",
        sql.FORECASTS,
        sql.stability(),
        recursive=True,
    )
)
def q_filter_info(spark, sf_dir):
    f = forecasts(spark, sf_dir)
    d = f.select("series", "row", "mu").join(stability.stabilise(f, ["series"]), ["series", "row"])
    return rounded(stability.filter_info(d, ["series"]), ["jitter", "max_slew", "clipped_share", "raw_jitter"])


EPOCHS = """ep AS (SELECT *, CAST(sum(j) OVER (PARTITION BY series ORDER BY ts) AS BIGINT) AS epoch FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY series ORDER BY ts) <> 3600 THEN 1 ELSE 0 END AS j FROM bars)),
grid1 AS (SELECT series || '#' || epoch AS series, ts, (ts - min(ts) OVER (PARTITION BY series, epoch)) // 3600 AS row, close FROM ep)"""


@query(
    sql.query(
        "SELECT e.series, e.ts, round(e.y, 6) + 0.0 AS y, round(g.close, 6) + 0.0 AS future_price FROM e LEFT JOIN grid1 g ON g.series = e.series AND g.row = e.row + 3",
        sql.TICKS,
        sql.bars(),
        EPOCHS,
        sql.ema("e", [("y", "close", 20, "close")], "grid1"),
        recursive=True,
    )
)
def q_epoch_reset(spark, sf_dir):
    """After a discontinuity averages begin anew, and labels don't reach across it."""
    d = windows.per_epoch(tables.event_bars(spark, sf_dir, G).select("series", "ts", "close"), G)
    out = labels.with_labels(ema(d, {"y": (F.col("close"), 20, F.col("close"))}), 3)
    return rounded(out.select("series", "ts", "y", "future_price"), ["y", "future_price"])


@query(
    sql.query(
        "SELECT name, CAST(k // 1000 AS BIGINT) AS window_id, CAST(k % 1000 AS INT) AS lane, CAST(r AS INT) AS rank FROM (SELECT o_orderkey AS k, o_custkey % 7 AS r, printf('w%08d_r%d.npz', o_orderkey, o_custkey % 7) AS name FROM orders)"
    ).removeprefix("WITH \n")
)
def q_named_windows(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return named_windows(o.select(F.format_string("w%08d_r%d.npz", "o_orderkey", F.col("o_custkey") % 7).alias("name")))


@query(sql.query("SELECT series, ts, window_id FROM (SELECT *, max(window_id) OVER (PARTITION BY series) AS top FROM fw) WHERE window_id = top", sql.BASE, FULL_GRID))
def q_latest_lane(spark, sf_dir):
    d = windows.full_windows(tables.event_grid(spark, sf_dir), W)
    return windows.newest_windows(d, 1).select("series", "ts", "window_id")


@query(None)
def q_mlp_train(spark, sf_dir):
    """Ten steps of the network on scaled returns and their contexts, a lane for each series: the loss of every step."""
    d = labels.with_labels(returns(tables.event_grid(spark, sf_dir), (1, 5)), 1)
    d = d.select("series", "row", (F.col("mom_ret1") / 1000).alias("a"), (F.col("mom_ret5") / 1000).alias("b"), (F.col("target") / 1000).alias("target"))
    d, names = mlp.with_contexts(d, ["a", "b"])
    _, losses = mlp.train(d.where(F.col("target").isNotNull()), names, "series", "row", steps=10, rate=0.02)
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(losses)], "step long, loss double")
