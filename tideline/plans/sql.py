"""DuckDB SQL of the query catalogue, written apart from the Spark plans as their oracle."""

from __future__ import annotations

TICKS = """ticks AS (
  SELECT event_id AS id, event_type AS series, epoch_us(ts) AS us, value AS price,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume,
    CASE WHEN event_id % 2 = 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) ELSE 0.0 END AS taker
  FROM events)"""


def bars(seconds=3600, source="ticks", name="bars"):
    return f"""{name} AS (
  SELECT series, CAST(us // {seconds * 1000000} * {seconds} AS BIGINT) AS ts, arg_min(price, (us, id)) AS open, max(price) AS high,
    min(price) AS low, arg_max(price, (us, id)) AS close, sum(volume) AS volume, sum(price * volume) AS quote_volume,
    count(*) AS trades, sum(taker) AS taker_buy_base
  FROM {source} GROUP BY 1, 2)"""


def grid(seconds=3600, source="bars", name="grid"):
    return f"""spans_{name} AS (SELECT series, min(ts) AS lo, max(ts) AS hi FROM {source} GROUP BY 1),
cells_{name} AS (SELECT series, lo, unnest(range(lo, hi + 1, {seconds})) AS ts FROM spans_{name}),
joined_{name} AS (SELECT c.series, c.ts, c.lo, b.open, b.high, b.low, b.close, b.volume, b.quote_volume, b.trades, b.taker_buy_base, b.close IS NULL AS gap
  FROM cells_{name} c LEFT JOIN {source} b ON b.series = c.series AND b.ts = c.ts),
{name} AS (
  SELECT series, ts, (ts - lo) // {seconds} AS row, coalesce(open, c) AS open, coalesce(high, c) AS high, coalesce(low, c) AS low, c AS close,
    coalesce(volume, 0) AS volume, coalesce(quote_volume, 0) AS quote_volume, coalesce(trades, 0) AS trades, coalesce(taker_buy_base, 0) AS taker_buy_base, gap
  FROM (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts) AS c FROM joined_{name}))"""


BASE = f"{TICKS}, {bars()}, {grid()}"


def query(final, *ctes, recursive=False):
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)}\n{final}"


RETURNS = """rets AS (
  SELECT *, {}, coalesce(lag(lp) OVER w, lp) AS lp_before FROM (SELECT *, ln(greatest(close, 1e-12)) AS lp FROM grid)
  WINDOW w AS (PARTITION BY series ORDER BY row))""".format(
    ", ".join(f"(lp - coalesce(lag(lp, {n}) OVER w, first_value(lp) OVER w)) * 1e3 AS mom_ret{n}" for n in (1, 5, 15, 60, 300, 900, 1800))
)

#: Inputs of the recursions.
INPUTS = """inp AS (
  SELECT *, mom_ret1 - coalesce(lag(mom_ret1) OVER (PARTITION BY series ORDER BY row), 0.0) AS mom_accel,
    (high - low) / greatest(close, 1e-12) * 1e3 AS rng,
    CASE WHEN volume > 0 THEN taker_buy_base / greatest(volume, 1e-12) ELSE 0.5 END AS ratio,
    CASE WHEN volume > 0 THEN quote_volume / greatest(volume, 1e-12) ELSE close END AS vwap, CAST(gap AS INT)::DOUBLE AS gapd
  FROM rets)"""


def ema(name, states, source="inp", keep=""):
    """states: (column, value, span, seed). A recursive CTE over row numbers."""
    a = {c: f"{2.0 / (span + 1.0)!r}::DOUBLE" for c, _, span, _ in states}
    first = ", ".join(f"(1 - {a[c]}) * ({seed}) + {a[c]} * ({x}) AS {c}" for c, x, _, seed in states)
    then = ", ".join(f"(1 - {a[c]}) * e.{c} + {a[c]} * ({x}) AS {c}" for c, x, _, _ in states)
    cols = ", ".join(c for c, *_ in states)
    return f"""{name}_r AS (
  SELECT series, row, {first} FROM {source} WHERE row = 0
  UNION ALL
  SELECT i.series, i.row, {then} FROM {name}_r e JOIN {source} i ON i.series = e.series AND i.row = e.row + 1),
{name} AS (SELECT i.*, {cols} FROM {source} i JOIN {name}_r USING (series, row))"""


WAVE1 = [
    *[(f"e_p{n}", "lp", n, "lp") for n in (5, 15, 60, 300, 900, 1800, 7200)],
    ("e_up", "greatest(mom_ret1, 0.0)", 300, "1e-12"),
    ("e_dn", "greatest(-mom_ret1, 0.0)", 300, "1e-12"),
    *[(f"e_rv{n}", "mom_ret1 * mom_ret1", n, "0.0") for n in (60, 300, 1800)],
    ("e_rng", "rng", 300, "0.0"),
    *[(f"e_v{n}", "volume", n, "greatest(volume, 1e-12)") for n in (60, 900)],
    *[(f"e_t{n}", "trades", n, "greatest(trades, 1.0)") for n in (60, 900)],
    ("e_if", "ratio", 60, "0.5"),
    ("e_is", "ratio", 300, "0.5"),
    ("e_gap", "gapd", 300, "0.0"),
    ("e_hi", "high", 900, "high"),
    ("e_lo", "low", 900, "low"),
]
WAVE2 = [("e_sig", "(e_p60 - e_p300) * 1e3", 60, "0.0"), ("e_vov", "abs(e_rv60 - e_rv300)", 900, "0.0")]

SIGNALS = {
    **{f"trend_ema{n}": f"(lp - e_p{n}) * 1e3" for n in (5, 15, 60, 300, 900, 1800, 7200)},
    "trend_macd": "(e_p60 - e_p300) * 1e3",
    "trend_macd_sig": "e_sig",
    "trend_macd_hist": "(e_p60 - e_p300) * 1e3 - e_sig",
    "trend_slope": "(e_p300 - e_p1800) * 1e3",
    **{f"mom_ret{n}": f"mom_ret{n}" for n in (1, 5, 15, 60, 300, 900, 1800)},
    "mom_accel": "mom_accel",
    "mom_rsi": "2 * e_up / (e_up + e_dn + 1e-12) - 1",
    **{f"vol_rv{n}": f"sqrt(e_rv{n})" for n in (60, 300, 1800)},
    "vol_range": "rng",
    "vol_range_ema": "e_rng",
    "vol_of_vol": "e_vov",
    **{f"flow_vol_z{n}": f"ln(1 + volume) - ln(1 + e_v{n})" for n in (60, 900)},
    **{f"flow_trades_z{n}": f"ln(1 + trades) - ln(1 + e_t{n})" for n in (60, 900)},
    "flow_imbalance_fast": "2 * e_if - 1",
    "flow_imbalance_slow": "2 * e_is - 1",
    "flow_vwap_dev": "(vwap - close) / greatest(close, 1e-12) * 1e3",
    "flow_notional": "ln(1 + quote_volume) - 10",
    "micro_gap_density": "e_gap",
    "micro_band_pos": "CASE WHEN e_hi - e_lo > 1e-9 THEN least(greatest((close - e_lo) / greatest(e_hi - e_lo, 1e-12), -3), 4) ELSE 0 END - 0.5",
    **{f"clock_{c}_{f}": f"{f}(2 * pi() * (ts % {p}) / {p})" for c, p in (("tod", 86400), ("dow", 604800)) for f in ("sin", "cos")},
}


def digits(name):
    """Decimals by which both engines are held to each other: fewer for squared per-mille returns."""
    return 2 if name == "vol_of_vol" else 6


def signals(names):
    return f"SELECT series, ts, {', '.join(f'round({SIGNALS[n]}, {digits(n)}) + 0.0 AS {n}' for n in names)} FROM s"


ALL = f"{BASE}, {RETURNS}, {INPUTS}, {ema('w1', WAVE1)}, {ema('s', WAVE2, 'w1')}"

#: A forecast from three returns, its label a horizon later, and tumbling windows.
FORECAST = """fc AS (
  SELECT series, row, ts, close, 0.02 * mom_ret1 - 0.01 * mom_ret5 + 0.005 * mom_ret15 AS mu, 0.5 + 0.001 * abs(mom_ret1) AS sigma,
    0.1 + 0.0005 * abs(mom_ret5) AS log_sigma, row // 24 AS window_id FROM rets),
lab AS (
  SELECT f.*, g.close AS future_price, CASE WHEN g.close IS NOT NULL THEN 1000 * (ln(greatest(g.close, 1e-12)) - ln(greatest(f.close, 1e-12))) END AS target
  FROM fc f LEFT JOIN fc g ON g.series = f.series AND g.row = f.row + 24)"""
FULL = """full_w AS (
  SELECT l.* FROM lab l JOIN (SELECT series, max(row) + 1 AS n FROM lab GROUP BY 1) m USING (series)
  WHERE (window_id + 1) * 24 <= n AND target IS NOT NULL)"""
FORECASTS = f"{BASE}, {RETURNS}, {FORECAST}, {FULL}"


def metrics(source, mu="mu", name="wm", extra=""):
    rel = "abs(close * exp(p / 1000) - close * exp(y / 1000)) / greatest(close * exp(y / 1000), 1e-9)"
    return f"""{name} AS (
  SELECT series, window_id, count(*) AS n, avg(abs(p - y)) AS mae, sqrt(avg((p - y) ** 2)) AS rmse, 100 * avg({rel}) AS mape_pct,
    avg(CASE WHEN {rel} <= 0.001 THEN 1.0 ELSE 0.0 END) AS band_accuracy,
    coalesce(avg(CASE WHEN (p > 0) = (y > 0) THEN 1.0 ELSE 0.0 END) FILTER (abs(y) > 0.25), 0.5) AS direction_acc,
    CASE WHEN var_pop(y) * count(*) > 1e-12 THEN 1 - sum((p - y) ** 2) / (var_pop(y) * count(*)) ELSE 0.0 END AS r2,
    CASE WHEN sum(y * y) > 0 THEN 1 - sum((p - y) ** 2) / sum(y * y) ELSE 0.0 END AS skill_vs_naive,
    avg(sign(p) * y * CASE WHEN abs(y) > 0.25 THEN 1.0 ELSE 0.0 END) AS reward, avg(p - y) AS bias,
    coalesce(avg(step), 0.0) AS jitter, coalesce(max(step), 0.0) AS max_slew, avg(coalesce(sigma, 1.0)) AS sigma_mean,
    avg(CASE WHEN abs(p - y) / greatest(coalesce(sigma, 1.0), 1e-6) <= 1 THEN 1.0 ELSE 0.0 END) AS calibration
  FROM (SELECT *, {mu} AS p, target AS y, abs({mu} - lag({mu}) OVER (PARTITION BY series, window_id ORDER BY row)) AS step FROM {source})
  GROUP BY series, window_id)"""


METRICS = ("mae", "rmse", "mape_pct", "band_accuracy", "direction_acc", "r2", "skill_vs_naive", "reward", "bias", "jitter", "max_slew", "sigma_mean", "calibration")


def rounded(names, digits=6):
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in names)


def stability(source="fc", name="st"):
    """The filter as a recursion over (value, samples)."""
    clipped = "least(greatest(i.mu, -120.0), 120.0)"
    base = "CASE WHEN e.n < 60 THEN least(0.5, 2.0 / 46.0 * (1.0 + 4.0 * (1.0 - e.n / 60.0::DOUBLE))) ELSE 2.0 / 46.0 END"
    a = f"least(greatest(({base}) / (1.0 + 0.8 * greatest(0.0::DOUBLE, i.sigma)), 1e-4), 0.95)"
    move = f"((1.0 - ({a})) * e.y + ({a}) * {clipped}) - e.y"
    return f"""{name}_r AS (
  SELECT series, row, least(greatest(mu, -120.0), 120.0)::DOUBLE AS y, 1::BIGINT AS n, false AS clipped FROM {source} WHERE row = 0
  UNION ALL
  SELECT series, row, (y + CASE WHEN abs(m) < 0.01 THEN 0.0 ELSE m END)::DOUBLE, n + 1, held FROM (
    SELECT series, row, y, n, abs(m0) > 0.08 AS held, CASE WHEN abs(m0) > 0.08 THEN CASE WHEN m0 > 0 THEN 0.08::DOUBLE ELSE -0.08::DOUBLE END ELSE m0 END AS m FROM (
      SELECT i.series, i.row, e.y, e.n, {move} AS m0 FROM {name}_r e JOIN {source} i ON i.series = e.series AND i.row = e.row + 1))),
{name} AS (SELECT i.*, y AS mu_smooth, clipped FROM {source} i JOIN {name}_r USING (series, row))"""
