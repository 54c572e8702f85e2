"""Queries that write to stores and files and read them back; their SQL says what must be there then."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import grid, mlp
from ..operators.signals import returns
from ..sources import chunks, store, tables
from . import sql
from .catalogue import BAR_COLUMNS, BAR_SQL, CODED, DECODED, G, labelled, query, rounded
from .streams import _folder

KLINE_SQL = """SELECT ts, round(CASE WHEN ts % 18000 = 0 THEN close + 1 ELSE close END, 6) + 0.0 AS close, round(volume, 6) + 0.0 AS volume, trades
FROM bars WHERE series = 'click'"""


@query(sql.query(KLINE_SQL, sql.TICKS, sql.bars()))
def q_klines(spark, sf_dir):
    """Bars as kline files, in milliseconds and microseconds; the second file's lines win where both have a second."""
    b = tables.event_bars(spark, sf_dir, G).where("series = 'click'")
    t = F.when(F.col("ts") % 7200 == 0, F.col("ts") * 1000).otherwise(F.col("ts") * 1_000_000)
    none = F.lit(0).cast("long")
    lines = lambda close: (t.alias("t"), "open", "high", "low", close.alias("c"), "volume", none.alias("e"), "quote_volume", "trades", "taker_buy_base", F.lit(0.0).alias("q"), F.lit("0").alias("u"))
    path = _folder(spark)
    b.select(*lines(F.col("close"))).write.option("header", "true").csv(f"{path}/a")
    b.where("ts % 18000 = 0").select(*lines(F.col("close") + 1)).write.csv(f"{path}/b")
    out = tables.klines(spark, [f"{path}/a", f"{path}/b"], "click")
    return rounded(out.select("ts", "close", "volume", "trades"), ["close", "volume"])


FALLBACK = "m AS (SELECT *, strftime(make_timestamp(ts * 1000000), '%d') AS d FROM bars)"


@query(sql.query("SELECT series, ts, round(CASE WHEN d < '11' OR d > '20' THEN close ELSE close + 1 END, 6) + 0.0 AS close FROM m", sql.TICKS, sql.bars(), FALLBACK))
def q_fallback(spark, sf_dir):
    """Days that the main source lacks come from the other."""
    b = tables.event_bars(spark, sf_dir, G).select("series", "ts", "close")
    day = F.date_format(F.timestamp_seconds("ts"), "dd")
    main = b.where((day < "11") | (day > "20"))
    out = tables.with_fallback(main, b.withColumn("close", F.col("close") + 1), 86400)
    return rounded(out, ["close"])


@query(sql.query("SELECT series, ts, round(close, 6) + 0.0 AS close FROM bars WHERE ts < 1704412800", sql.TICKS, sql.bars()))
def q_clamped_range(spark, sf_dir):
    out = tables.clamped_range(tables.event_bars(spark, sf_dir, G), 0, 1704412800)
    return rounded(out.select("series", "ts", "close"), ["close"])


@query(
    sql.query(
        "SELECT CAST(CASE WHEN k % 2 = 0 THEN t // 1000 ELSE t // 1000000 END AS BIGINT) AS ts, k FROM (SELECT o_orderkey AS k, CAST(epoch(o_orderdate) AS BIGINT) * CASE WHEN o_orderkey % 2 = 0 THEN 1000 ELSE 1000000 END + 7 AS t FROM orders)"
    ).removeprefix("WITH \n")
)
def q_epoch_units(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("s"))
    t = F.col("s") * F.when(F.col("k") % 2 == 0, 1000).otherwise(1_000_000) + 7
    return o.select(s.epoch_seconds(t).alias("ts"), "k")


SHARED = """ends AS (SELECT min(ts) AS lo, max(ts) AS hi FROM bars),
cells AS (SELECT series, lo, unnest(range(lo, hi + 1, 3600)) AS ts FROM (SELECT DISTINCT series FROM bars), ends),
sg AS (SELECT c.series, c.ts, (c.ts - lo) // 3600 AS row, b.close IS NULL AS gap,
  coalesce(last_value(b.close IGNORE NULLS) OVER (PARTITION BY c.series ORDER BY c.ts), first_value(b.close IGNORE NULLS) OVER (PARTITION BY c.series ORDER BY c.ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS close
  FROM cells c LEFT JOIN bars b ON b.series = c.series AND b.ts = c.ts)"""


@query(sql.query("SELECT series, ts, row, gap, round(close, 6) + 0.0 AS close FROM sg", sql.TICKS, sql.bars(), SHARED))
def q_shared_grid(spark, sf_dir):
    """All series on one grid: cells before a series' first bar take its first close."""
    out = grid.on_grid(tables.event_bars(spark, sf_dir, G), G, shared=True)
    return rounded(out.select("series", "ts", "row", "gap", "close"), ["close"])


@query(sql.query(f"SELECT series, ts, {BAR_SQL}, trades FROM bars", sql.TICKS, sql.bars()))
def q_bars_store(spark, sf_dir):
    """Bars by month, written and read back."""
    path = _folder(spark)
    store.write_bars(tables.event_bars(spark, sf_dir, G), path)
    return rounded(spark.read.parquet(path).drop("month"), BAR_COLUMNS)


@query(
    sql.query(
        "SELECT count(*) AS n_chunks, CAST(sum(n) AS BIGINT) AS bars, round((max(t1) - min(t0)) / 86400.0, 6)::DOUBLE AS days FROM (SELECT count(*) AS n, min(ts) AS t0, min(ts) + count(*) * 3600 AS t1 FROM grid GROUP BY series, strftime(make_timestamp(ts * 1000000), '%Y-%m'))",
        sql.BASE,
    )
)
def q_manifest(spark, sf_dir):
    """The catalogue of a bar store, rebuilt from its files and described."""
    path = _folder(spark)
    store.write_bars(tables.event_grid(spark, sf_dir), f"{path}/bars")
    store.rebuild_manifest(spark, f"{path}/bars", f"{path}/manifest", G, {"symbol": "X"})
    return store.describe(spark, f"{path}/manifest").select("n_chunks", "bars", "days")


def tape_store(spark, sf_dir):
    """A run's tape: all windows saved, then every third again with other targets."""
    rows = labelled(spark, sf_dir).where("series = 'click'")
    rows = rows.select("window_id", "ts", F.col("close").alias("price_now"), F.col("mu").alias("mu_raw"), "sigma", F.col("target").alias("target_permille"), (F.col("row") % 2).cast("int").alias("lane"))
    run = store.RunStore(spark, _folder(spark), "run")
    run.save_windows(rows)
    run.save_windows(rows.where("window_id % 3 = 0").withColumn("target_permille", F.col("target_permille") + 1))
    return run


TAPE_SQL = "tp AS (SELECT window_id, ts, close, mu, sigma, CASE WHEN window_id % 3 = 0 THEN target + 1 ELSE target END AS target, CAST(row % 2 AS INT) AS lane FROM lab WHERE series = 'click')"


@query(
    sql.query(
        "SELECT window_id, ts, round(close, 6) + 0.0 AS price_now, round(target, 6) + 0.0 AS target_permille, round(close * (exp(sigma / 1000) - 1), 6) + 0.0 AS sigma_price FROM tp WHERE lane = 1 AND window_id > (SELECT max(window_id) FROM tp) - 5",
        sql.FORECASTS,
        TAPE_SQL,
    )
)
def q_tape_series(spark, sf_dir):
    """One lane's newest five windows of an upserted tape, the band in units of the price."""
    d = tape_store(spark, sf_dir).series(last=5, lane=1)
    return rounded(d.select("window_id", "ts", "price_now", "target_permille", "sigma_price"), ["price_now", "target_permille", "sigma_price"])


@query(sql.query("SELECT window_id, ts, lane, round(mu, 6) + 0.0 AS mu_raw, round(target, 6) + 0.0 AS target_permille, 'run' AS run_id FROM tp", sql.FORECASTS, TAPE_SQL))
def q_tape_consolidated(spark, sf_dir):
    d = spark.read.parquet(tape_store(spark, sf_dir).consolidate(_folder(spark)))
    return rounded(d.select("window_id", "ts", "lane", "mu_raw", "target_permille", "run_id"), ["mu_raw", "target_permille"])


@query(sql.query("SELECT window_id, count(*) AS n, min(ts) AS t0 FROM tp WHERE window_id >= 2 GROUP BY 1 ORDER BY 1 LIMIT 4", sql.FORECASTS, TAPE_SQL))
def q_tape_windows(spark, sf_dir):
    """Windows of a tape one by one, from the third on, four at most."""
    rows = [w.agg(F.first("window_id"), F.count("*"), F.min("ts")).first() for w in tape_store(spark, sf_dir).windows(2, 4)]
    return spark.createDataFrame([(int(a), b, c) for a, b, c in rows], "window_id long, n long, t0 long")


@query(sql.query('SELECT window_id AS "window", round(mae, 6) + 0.0 AS mae_permille FROM wm WHERE series = \'click\'', sql.FORECASTS, sql.metrics("full_w")))
def q_metrics_store(spark, sf_dir):
    """Metrics appended in two batches."""
    from ..operators.labels import window_metrics
    from .catalogue import scored_rows

    m = window_metrics(scored_rows(labelled(spark, sf_dir)), ["series", "window_id"]).where("series = 'click'")
    m = m.select(F.col("window_id").alias("window"), F.col("mae").alias("mae_permille"))
    run = store.RunStore(spark, _folder(spark), "run")
    run.append_metrics(m.where("window % 2 = 0"))
    run.append_metrics(m.where("window % 2 = 1"))
    return rounded(run.metrics(), ["mae_permille"])


NET = mlp.init(2, 3, 11)


def _net_sql():
    w = {k: v.tolist() for k, v in NET.items()}
    hidden = [f"tanh(a * ({w['w1'][0][j]!r}::DOUBLE) + b * ({w['w1'][1][j]!r}::DOUBLE) + ({w['b1'][j]!r}::DOUBLE)) AS h{j}" for j in range(3)]
    out = [" + ".join([*(f"h{j} * ({w['w2'][j][k]!r}::DOUBLE)" for j in range(3)), f"({w['b2'][k]!r}::DOUBLE)"]) for k in range(2)]
    return f"""SELECT series, row, round({out[0]}, 6) + 0.0 AS mu, round(least(greatest({out[1]}, -4.0), 4.0), 6) + 0.0 AS log_sigma
FROM (SELECT series, row, {', '.join(hidden)} FROM (SELECT series, row, mom_ret1 / 1000 AS a, mom_ret5 / 1000 AS b FROM rets))"""


@query(sql.query(_net_sql(), sql.BASE, sql.RETURNS))
def q_mlp_predict(spark, sf_dir):
    """A network's forecasts, its weights out of a checkpoint."""
    run = store.RunStore(spark, _folder(spark), "run")
    run.save_checkpoint(5, {"net": {k: v * 2 for k, v in NET.items()}}, keep=2)
    run.save_checkpoint(7, {"net": NET}, keep=2)
    weights = run.load_checkpoint()[1]["net"]
    d = returns(tables.event_grid(spark, sf_dir), (1, 5))
    d = d.select("series", "row", (F.col("mom_ret1") / 1000).alias("a"), (F.col("mom_ret5") / 1000).alias("b"))
    return rounded(mlp.predict(d, weights, ["a", "b"]).drop("a", "b"), ["mu", "log_sigma"])


CHUNK_SQL = """SELECT series, ts, round((c + open_off) / 100.0, 6)::DOUBLE AS open, round((c + high_off) / 100.0, 6)::DOUBLE AS high, round((c + low_off) / 100.0, 6)::DOUBLE AS low,
  round(c / 100.0, 6)::DOUBLE AS close, round(v, 6) + 0.0 AS volume, round(v * (c / 100.0::DOUBLE + vwap_off / 100.0::DOUBLE), 4) AS quote_volume,
  CAST(trades_u16 AS BIGINT) AS trades, round(v * tb_ratio_u8 / 255, 6) AS taker_buy_base, gap FROM dec"""


def chunk_store(spark, sf_dir):
    path = _folder(spark)
    chunks.write_chunks(tables.event_grid(spark, sf_dir), path, G, "X")
    return path


@query(sql.query(CHUNK_SQL, sql.BASE, CODED, DECODED))
def q_chunk_files(spark, sf_dir):
    """The whole grid as chunk files, written and read back."""
    out = chunks.read_chunks(spark, chunk_store(spark, sf_dir))
    return rounded(rounded(out, [c for c in BAR_COLUMNS if c != "quote_volume"]), ["quote_volume"], 4)


@query(sql.query(f"{CHUNK_SQL} WHERE ts >= 1704240000 AND ts < 1704412800 AND series IN ('click', 'view')", sql.BASE, CODED, DECODED))
def q_chunk_range(spark, sf_dir):
    """Two days of two series, from the chunks that the catalogue names."""
    out = chunks.chunk_range(spark, chunk_store(spark, sf_dir), 1704240000, 1704412800).where("series IN ('click', 'view')")
    return rounded(rounded(out, [c for c in BAR_COLUMNS if c != "quote_volume"]), ["quote_volume"], 4)
