"""Forty causal signals of a gap-filled series, and the running normaliser."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from .blocks import with_history
from .ema import ema

#: Spans and lags in rows.
TREND_SPANS = (5, 15, 60, 300, 900, 1800, 7200)
RETURN_LAGS = (1, 5, 15, 60, 300, 900, 1800)
VOL_SPANS = (60, 300, 1800)
FLOW_SPANS = (60, 900)

#: Names in column order.
SIGNALS = (
    *(f"trend_ema{n}" for n in TREND_SPANS), "trend_macd", "trend_macd_sig", "trend_macd_hist", "trend_slope",
    *(f"mom_ret{n}" for n in RETURN_LAGS), "mom_accel", "mom_rsi",
    *(f"vol_rv{n}" for n in VOL_SPANS), "vol_range", "vol_range_ema", "vol_of_vol",
    *(f"flow_vol_z{n}" for n in FLOW_SPANS), *(f"flow_trades_z{n}" for n in FLOW_SPANS),
    "flow_imbalance_fast", "flow_imbalance_slow", "flow_vwap_dev", "flow_notional",
    "micro_gap_density", "micro_band_pos", "clock_tod_sin", "clock_tod_cos", "clock_dow_sin", "clock_dow_cos",
)


def returns(bars: DataFrame, lags=RETURN_LAGS, lag_offset: int = 0) -> DataFrame:
    """Adds lp, mom_ret<L> and mom_accel. Before the series begins its first log price holds.
    lag_offset 1 gives each return a lag of one row less. Blocks bring the rows that the longest lag needs along."""
    d, w, own = with_history(bars.withColumn("lp", s.log_price(F.col("close"))), "series", "row", max(*lags, 2))
    first = F.first("lp").over(w.rowsBetween(Window.unboundedPreceding, 0))  # of the series, where a lag leads before it
    d = d.withColumns({f"mom_ret{n}": (F.col("lp") - F.coalesce(F.lag("lp", n - lag_offset).over(w), first)) * 1e3 for n in lags})
    if 1 in lags:
        d = d.withColumn("mom_accel", F.col("mom_ret1") - F.coalesce(F.lag("mom_ret1").over(w), F.lit(0.0)))
    return d.where(own).drop("block_", "own_")


def signals(bars: DataFrame, lag_offset: int = 0, names=SIGNALS) -> DataFrame:
    """series, ts, row, close and the signals of a gridded series. EMAs that no asked name needs are
    not computed; the others run in two waves, the second over results of the first."""
    c = F.col
    need = lambda *prefixes: any(n.startswith(p) for n in names for p in prefixes)
    d = bars.select("series", "ts", "row", "close", "high", "low", "volume", "quote_volume", "trades", "taker_buy_base", "gap")
    d = returns(d, lag_offset=lag_offset)
    ratio = s.taker_ratio(c("volume"), c("taker_buy_base"))
    rng = s.range_permille(c("high"), c("low"), c("close"))
    r1 = c("mom_ret1")
    one = {}
    for n in TREND_SPANS:
        if f"trend_ema{n}" in names or (n in (60, 300) and need("trend_macd")) or (n in (300, 1800) and "trend_slope" in names):
            one[f"e_p{n}"] = (c("lp"), n, c("lp"))
    if "mom_rsi" in names:
        one |= {"e_up": (F.greatest(r1, F.lit(0.0)), 300, 1e-12), "e_dn": (F.greatest(-r1, F.lit(0.0)), 300, 1e-12)}
    for n in VOL_SPANS:
        if f"vol_rv{n}" in names or (n in (60, 300) and "vol_of_vol" in names):
            one[f"e_rv{n}"] = (r1 * r1, n, 0.0)
    if "vol_range_ema" in names:
        one["e_rng"] = (rng, 300, 0.0)
    for n in FLOW_SPANS:
        if f"flow_vol_z{n}" in names:
            one[f"e_v{n}"] = (c("volume"), n, F.greatest(c("volume"), F.lit(1e-12)))
        if f"flow_trades_z{n}" in names:
            one[f"e_t{n}"] = (c("trades"), n, F.greatest(c("trades").cast("double"), F.lit(1.0)))
    if need("flow_imbalance"):
        one |= {"e_if": (ratio, 60, 0.5), "e_is": (ratio, 300, 0.5)}
    if "micro_gap_density" in names:
        one["e_gap"] = (c("gap").cast("double"), 300, 0.0)
    if "micro_band_pos" in names:
        one |= {"e_hi": (c("high"), 900, c("high")), "e_lo": (c("low"), 900, c("low"))}
    if one:
        d = ema(d, one)
    two = {}
    if need("trend_macd_"):
        two["e_sig"] = ((c("e_p60") - c("e_p300")) * 1e3, 60, 0.0)
    if "vol_of_vol" in names:
        two["e_vov"] = (F.abs(c("e_rv60") - c("e_rv300")), 900, 0.0)
    if two:
        d = ema(d, two)
    macd = (c("e_p60") - c("e_p300")) * 1e3
    z = lambda x, e: s.log1p(c(x)) - s.log1p(F.greatest(c(e), F.lit(0.0)))
    out = {f"trend_ema{n}": (c("lp") - c(f"e_p{n}")) * 1e3 for n in TREND_SPANS}
    out |= {"trend_macd": macd, "trend_macd_sig": c("e_sig"), "trend_macd_hist": macd - c("e_sig"), "trend_slope": (c("e_p300") - c("e_p1800")) * 1e3}
    out |= {f"mom_ret{n}": c(f"mom_ret{n}") for n in RETURN_LAGS} | {"mom_accel": c("mom_accel")}
    out |= {"mom_rsi": 2 * c("e_up") / (c("e_up") + c("e_dn") + 1e-12) - 1}
    out |= {f"vol_rv{n}": F.sqrt(F.greatest(c(f"e_rv{n}"), F.lit(0.0))) for n in VOL_SPANS}
    out |= {"vol_range": rng, "vol_range_ema": c("e_rng"), "vol_of_vol": c("e_vov")}
    out |= {f"flow_vol_z{n}": z("volume", f"e_v{n}") for n in FLOW_SPANS} | {f"flow_trades_z{n}": z("trades", f"e_t{n}") for n in FLOW_SPANS}
    out |= {"flow_imbalance_fast": 2 * c("e_if") - 1, "flow_imbalance_slow": 2 * c("e_is") - 1}
    out |= {"flow_vwap_dev": (s.vwap(c("volume"), c("quote_volume"), c("close")) - c("close")) / F.greatest(c("close"), F.lit(s.EPS)) * 1e3}
    out |= {"flow_notional": s.log1p(c("quote_volume")) - 10, "micro_gap_density": c("e_gap")}
    # a flat band has position 0 (exactly: rounding noise over rounding noise says nothing)
    band = c("e_hi") - c("e_lo")
    place = F.when(band > 1e-9, (c("close") - c("e_lo")) / F.greatest(band, F.lit(s.EPS))).otherwise(0.0)
    out |= {"micro_band_pos": s.clip(place, -3, 4) - 0.5}
    for label, period in (("tod", 86400), ("dow", 604800)):
        out |= {f"clock_{label}_sin": s.phase(c("ts"), period, F.sin), f"clock_{label}_cos": s.phase(c("ts"), period, F.cos)}
    return d.select("series", "ts", "row", "close", *[s.finite(out[n]).alias(n) for n in names])
