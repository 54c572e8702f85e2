"""Queries of the networks: convolutions, the objective, training in step, and the walk forward."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import deep, labels, training
from ..operators.signals import returns
from ..sources import tables
from ..sources.walk import WalkForward
from . import sql
from .catalogue import METRIC_SQL, H, labelled, query, rounded, scored_rows
from .streams import _folder

#: Rows of a walk's windows: five days of hours.
STEP = 120


def scaled_returns(spark, sf_dir):
    """Two returns of the hourly grid in percent of one: what the networks here read."""
    d = returns(tables.event_grid(spark, sf_dir), (1, 5))
    return d.select("series", "row", "ts", "close", (F.col("mom_ret1") / 1000).alias("a"), (F.col("mom_ret5") / 1000).alias("b"))


SCALED = "sc AS (SELECT series, row, ts, close, mom_ret1 / 1000 AS a, mom_ret5 / 1000 AS b FROM rets)"

#: Two outputs of a convolution over two inputs, three and two taps, eight rows apart.
CONV, GAP = {"c1": ({"a": [0.5, -0.25, 0.125], "b": [1.0, 0.5]}, 0.1), "c2": ({"b": [-0.3, 0.0, 0.7]}, -0.2)}, 8


def _conv_sql():
    def tap(name, k):
        return name if k == 0 else f"coalesce(lag({name}, {k * GAP}) OVER w, 0.0)"

    sums = {c: " + ".join([f"({bias}::DOUBLE)", *(f"({v}::DOUBLE) * {tap(i, k)}" for i, taps in ws.items() for k, v in enumerate(taps))]) for c, (ws, bias) in CONV.items()}
    return f"SELECT series, row, {', '.join(f'round({x}, 6) + 0.0 AS {c}' for c, x in sums.items())} FROM sc WINDOW w AS (PARTITION BY series ORDER BY row)"


@query(sql.query(_conv_sql(), sql.BASE, sql.RETURNS, SCALED))
def q_causal_conv(spark, sf_dir):
    d = deep.causal_conv(scaled_returns(spark, sf_dir).select("series", "row", "a", "b"), CONV, GAP)
    return rounded(d.select("series", "row", *CONV), CONV)


@query(None)
def q_deep_forecast(spark, sf_dir):
    """The whole network, in two halves of the time: the second goes on from the state that the first left."""
    w, d = deep.init(2), scaled_returns(spark, sf_dir).select("series", "row", "a", "b")
    early = deep.forecast(d.where("row < 360"), ["a", "b"], w)
    z = deep.features_of(d.where(F.col("row") >= 360 - deep.reach(w)), ["a", "b"], w).where("row >= 360")
    late = deep.recur(z, w, carry=deep.carried(early))
    return rounded(early.unionByName(late).drop("h"), ["mu", "log_sigma", "logit"])


TERM_NAMES = (*training.TERMS, "loss")
OBJECTIVE = f"""SELECT series, window_id, n, {', '.join(f'round({t}, 6) + 0.0 AS {t}' for t in training.TERMS)},
  round(huber + 0.25 * nll + 0.15 * direction + 0.6 * smooth + 0.2 * curve, 6) + 0.0 AS loss FROM (
  SELECT series, window_id, count(*) AS n, avg(hub * (1 + 0.35 * abs(target) / (0.25 + moved + 1e-6))) AS huber, avg(ls + 0.5 * e * e * exp(-2 * ls)) AS nll,
    coalesce(avg(-ln(CASE WHEN target > 0 THEN p ELSE 1 - p END)) FILTER (abs(target) > 0.25), 0.0) AS direction,
    coalesce(avg(d1 * d1), 0.0) AS smooth, coalesce(avg(d2 * d2), 0.0) AS curve
  FROM (SELECT *, CASE WHEN abs(e) <= 2 THEN 0.5 * e * e ELSE 2 * (abs(e) - 1) END AS hub, 1 / (1 + exp(-mu / 100)) AS p, avg(abs(target)) OVER v AS moved, d1 - lag(d1) OVER w AS d2
    FROM (SELECT *, mu - target AS e, least(greatest(log_sigma, -4), 4) AS ls, mu - lag(mu) OVER (PARTITION BY series, window_id ORDER BY row) AS d1 FROM full_w)
    WINDOW v AS (PARTITION BY series, window_id), w AS (PARTITION BY series, window_id ORDER BY row))
  GROUP BY 1, 2)"""


@query(sql.query(OBJECTIVE, sql.FORECASTS))
def q_objective(spark, sf_dir):
    """The five terms of the objective over each window, with a hundredth of the forecast as the logit of its direction."""
    d = scored_rows(labelled(spark, sf_dir)).withColumn("logit", F.col("mu") / 100)
    return rounded(training.objective(d, ["series", "window_id"]), TERM_NAMES)


@query(None)
def q_train_in_step(spark, sf_dir):
    """Eight steps over all series, as one job of barrier tasks."""
    d = labels.with_labels(scaled_returns(spark, sf_dir), 1).withColumn("target", F.col("target") / 1000)
    _, _, told = training.train_in_step(d, ["a", "b"], "series", "row", 8, rate=0.02, tasks=min(4, spark.sparkContext.defaultParallelism))
    return spark.createDataFrame([tuple(t.values()) for t in told], "step long, loss double, " + ", ".join(f"{t} double" for t in training.TERMS) + ", rate double")


def _weights():
    """Fixed weights, so large that forecasts move."""
    w = training.init(2, 3, 11)
    return {**w, "w2": w["w2"] * 100}


def _walk_sql():
    w = {k: v.tolist() for k, v in _weights().items()}
    hidden = [f"tanh(a * ({w['w1'][0][j]!r}::DOUBLE) + b * ({w['w1'][1][j]!r}::DOUBLE) + ({w['b1'][j]!r}::DOUBLE)) AS h{j}" for j in range(3)]
    out = [" + ".join([*(f"h{j} * ({w['w2'][j][k]!r}::DOUBLE)" for j in range(3)), f"({w['b2'][k]!r}::DOUBLE)"]) for k in range(2)]
    return [
        f"net AS (SELECT series, row, ts, close, {out[0]} AS mu, exp(least(greatest({out[1]}, -4.0), 4.0)) AS sigma FROM (SELECT *, {', '.join(hidden)} FROM sc))",
        sql.stability("net"),
        f"""ripe AS (
  SELECT f.series, f.row, f.row // {STEP} AS window_id, f.close, f.mu, f.mu_smooth, f.sigma, 1000 * (ln(greatest(g.close, 1e-12)) - ln(greatest(f.close, 1e-12))) AS target
  FROM st f JOIN net g ON g.series = f.series AND g.row = f.row + {H}
  WHERE (f.row // {STEP} + 1) * {STEP} - 1 + {H} <= (SELECT max(row) FROM net m WHERE m.series = f.series))""",
        sql.metrics("ripe", "mu_smooth"),
    ]


@query(sql.query(f"SELECT series, window_id, n, {METRIC_SQL} FROM wm", sql.BASE, sql.RETURNS, SCALED, *_walk_sql(), recursive=True))
def q_walk_scores(spark, sf_dir):
    """A walk forward with fixed weights, cut off after two windows and gone on with: the scores of all windows that matured."""
    folder = _folder(spark)
    walk = lambda: WalkForward(spark, folder, "run", ["a", "b"], H)
    rows = scaled_returns(spark, sf_dir).withColumn("window_id", F.floor(F.col("row") / STEP))
    first = walk()
    first.begin(rows, _weights(), rate=0.0)
    first.run(2)
    last = walk()
    last.run()
    return rounded(last.metrics().select("series", F.col("window_id").cast("long").alias("window_id"), "n", *sql.METRICS), sql.METRICS)
