"""Schemas of the engine's tables."""

BARS = (
    "series string, ts long, open double, high double, low double, close double, volume double, "
    "quote_volume double, trades long, taker_buy_base double, gap boolean"
)
KLINES = (
    "t long, open double, high double, low double, close double, volume double, close_time long, quote_volume double, "
    "trades long, taker_buy_base double, taker_buy_quote double, unused string"
)
TAPE = (
    "run_id string, window_id long, lane int, rank int, ts long, price_now double, mu_raw double, mu_smooth double, "
    "sigma double, pred_price double, true_future_price double, target_permille double"
)
#: Metric columns of a run, in the order of its files.
METRICS = (
    "window", "wall_time", "t0", "t_end", "utc", "rank", "loss", "acc_loss", "nll", "dir_loss", "smooth", "curve",
    "mae_permille", "rmse_permille", "mape_pct", "band_accuracy", "direction_acc", "r2", "skill_vs_naive", "reward",
    "bias_permille", "jitter_permille", "max_slew_permille", "sigma_mean", "calibration", "grad_norm", "lr", "sim_sec_per_sec",
)
METRICS_SCHEMA = ", ".join(
    f"{c} {'long' if c in ('window', 't0', 't_end') else 'int' if c == 'rank' else 'string' if c == 'utc' else 'double'}" for c in METRICS
)
#: The metric columns that a warehouse keeps, in its order.
WAREHOUSE_METRICS = (
    "window", "utc", "loss", "mae_permille", "band_accuracy", "direction_acc", "skill_vs_naive", "calibration", "jitter_permille",
    "sim_sec_per_sec",
)
#: Metrics of which the greatest, and of which the least, running average is the best.
BEST_HIGH = ("band_accuracy", "direction_acc", "skill_vs_naive", "r2", "reward")
BEST_LOW = ("mae_permille", "rmse_permille", "jitter_permille", "mape_pct")
