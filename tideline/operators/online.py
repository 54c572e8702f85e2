"""The signals and scores of the batch operators, row by row with state that can be saved and put back.

One engine holds a series' recursions: moving averages, the log prices that the longest lag looks back to, and the
second that it expects next. A row at any other second begins anew. State is plain data (JSON), so a
state store, a checkpoint or a file can hold it."""

from __future__ import annotations

import copy
import json
import math
from collections import deque

import numpy as np

from .ema import alpha
from .signals import FLOW_SPANS, RETURN_LAGS, SIGNALS, TREND_SPANS, VOL_SPANS

EPS = 1e-12
#: Averages of the first wave, in the order of the state's vector: names and spans.
FIRST = (
    *((f"p{n}", n) for n in TREND_SPANS), ("up", 300), ("dn", 300), *((f"rv{n}", n) for n in VOL_SPANS), ("rng", 300),
    *((f"v{n}", n) for n in FLOW_SPANS), *((f"t{n}", n) for n in FLOW_SPANS), ("if", 60), ("is", 300), ("gap", 300), ("hi", 900), ("lo", 900),
)
_AT = {name: k for k, (name, _) in enumerate(FIRST)}
_A = np.array([alpha(n) for _, n in FIRST])
_A2 = np.array([alpha(60), alpha(900)])  # of the second wave: the signal line, the volatility of volatility


class OnlineSignals:
    """update() takes bars in order and gives a row of signals for each; with advance=False the state stays
    as it was, for a look ahead."""

    def __init__(self, seconds: int = 1, state: str | None = None):
        self.seconds, self.resets = seconds, 0
        self._clear()
        if state is not None:
            s = json.loads(state)
            self.expect, self.resets, self.r1 = s["expect"], s["resets"], s["r1"]
            self.y = None if s["y"] is None else np.array(s["y"])
            self.z, self.past = np.array(s["z"]), deque(s["past"], max(RETURN_LAGS))

    def _clear(self):
        self.expect, self.y, self.z, self.r1 = None, None, np.zeros(2), 0.0
        self.past = deque(maxlen=max(RETURN_LAGS))

    def state(self) -> str:
        y = None if self.y is None else self.y.tolist()
        return json.dumps({"expect": self.expect, "resets": self.resets, "r1": self.r1, "y": y, "z": self.z.tolist(), "past": list(self.past)})

    def update(self, bars: list, advance: bool = True) -> list:
        """bars: dicts of ts, open, high, low, close, volume, quote_volume, trades, taker_buy_base, gap."""
        held = None if advance else copy.deepcopy(self.__dict__)
        out = [self._step(b) for b in bars]
        if held is not None:
            self.__dict__ = held
        return out

    def _step(self, b):
        if self.expect is not None and b["ts"] != self.expect:
            self._clear()
            self.resets += 1
        self.expect = b["ts"] + self.seconds
        close, volume = b["close"], b["volume"]
        lp = math.log(max(close, EPS))
        before = self.past
        ret = {n: (lp - (before[-n] if len(before) >= n else before[0] if before else lp)) * 1e3 for n in RETURN_LAGS}
        r1 = ret[1]
        accel, self.r1 = r1 - self.r1 if before else r1, r1
        self.past.append(lp)
        ratio = b["taker_buy_base"] / max(volume, EPS) if volume > 0 else 0.5
        rng = (b["high"] - b["low"]) / max(close, EPS) * 1e3
        x = [lp] * len(TREND_SPANS) + [max(r1, 0.0), max(-r1, 0.0)] + [r1 * r1] * len(VOL_SPANS) + [rng]
        x += [volume] * len(FLOW_SPANS) + [float(b["trades"])] * len(FLOW_SPANS) + [ratio, ratio, float(b["gap"]), b["high"], b["low"]]
        x = np.array(x)
        if self.y is None:
            n = len(FLOW_SPANS)
            seeds = [lp] * len(TREND_SPANS) + [EPS, EPS] + [0.0] * (len(VOL_SPANS) + 1) + [max(volume, EPS)] * n + [max(float(b["trades"]), 1.0)] * n
            self.y = np.array(seeds + [0.5, 0.5, 0.0, b["high"], b["low"]])
        self.y = (1 - _A) * self.y + _A * x
        e = lambda name: self.y[_AT[name]]
        macd = (e("p60") - e("p300")) * 1e3
        self.z = (1 - _A2) * self.z + _A2 * np.array([macd, abs(e("rv60") - e("rv300"))])
        band = e("hi") - e("lo")
        place = (close - e("lo")) / max(band, EPS) if band > 1e-9 else 0.0
        vwap = b["quote_volume"] / max(volume, EPS) if volume > 0 else close
        level = lambda value, mean: math.log(1 + value) - math.log(1 + max(mean, 0.0))
        phase = lambda f, period: f(2 * math.pi * (b["ts"] % period) / period)
        got = {f"trend_ema{n}": (lp - e(f"p{n}")) * 1e3 for n in TREND_SPANS}
        got |= {"trend_macd": macd, "trend_macd_sig": self.z[0], "trend_macd_hist": macd - self.z[0], "trend_slope": (e("p300") - e("p1800")) * 1e3}
        got |= {f"mom_ret{n}": v for n, v in ret.items()} | {"mom_accel": accel, "mom_rsi": 2 * e("up") / (e("up") + e("dn") + EPS) - 1}
        got |= {f"vol_rv{n}": math.sqrt(max(e(f"rv{n}"), 0.0)) for n in VOL_SPANS} | {"vol_range": rng, "vol_range_ema": e("rng"), "vol_of_vol": self.z[1]}
        got |= {f"flow_vol_z{n}": level(volume, e(f"v{n}")) for n in FLOW_SPANS} | {f"flow_trades_z{n}": level(b["trades"], e(f"t{n}")) for n in FLOW_SPANS}
        got |= {"flow_imbalance_fast": 2 * e("if") - 1, "flow_imbalance_slow": 2 * e("is") - 1, "flow_vwap_dev": (vwap - close) / max(close, EPS) * 1e3}
        got |= {"flow_notional": math.log(1 + b["quote_volume"]) - 10, "micro_gap_density": e("gap"), "micro_band_pos": min(max(place, -3.0), 4.0) - 0.5}
        got |= {"clock_tod_sin": phase(math.sin, 86400), "clock_tod_cos": phase(math.cos, 86400), "clock_dow_sin": phase(math.sin, 604800), "clock_dow_cos": phase(math.cos, 604800)}
        return [float(got[n]) if math.isfinite(got[n]) else 0.0 for n in SIGNALS]


def score_window(close, mu, sigma, target, band_bps: float = 10.0, floor: float = 0.25) -> dict:
    """The scores of one window, as labels.window_metrics gives them."""
    close, mu, sigma, y = (np.asarray(v, float) for v in (close, mu, sigma, target))
    err, true = mu - y, close * np.exp(y / 1000)
    rel, big, step = np.abs(close * np.exp(mu / 1000) - true) / np.maximum(true, 1e-9), np.abs(y) > floor, np.abs(np.diff(mu))
    spread, y2, e2 = y.var() * len(y), (y * y).sum(), (err * err).sum()
    return {
        "n": len(y), "mae": np.abs(err).mean(), "rmse": math.sqrt((err * err).mean()), "mape_pct": 100 * rel.mean(),
        "band_accuracy": (rel <= band_bps / 10000).mean(), "direction_acc": ((mu > 0) == (y > 0))[big].mean() if big.any() else 0.5,
        "r2": 1 - e2 / spread if spread > 1e-12 else 0.0, "skill_vs_naive": 1 - e2 / y2 if y2 > 0 else 0.0, "reward": (np.sign(mu) * y * big).mean(),
        "bias": err.mean(), "jitter": step.mean() if len(step) else 0.0, "max_slew": step.max() if len(step) else 0.0,
        "sigma_mean": sigma.mean(), "calibration": (np.abs(err) / np.maximum(sigma, 1e-6) <= 1).mean(),
    }
