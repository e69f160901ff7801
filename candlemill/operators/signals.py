"""Price signals re-aimed from trader rules to plain price columns."""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from candlemill.functions.columns import clip, divide, ln, safe_tanh, sign_eps
from candlemill.functions.windows import over_halo, sliding_extremes
from candlemill.operators.features import rows

PRICE_EPS = sys.float_info.min


@dataclass(frozen=True)
class SignalConfig:
    # fixed values: defaults of the signal formulas
    short_ma: int = 8
    long_ma: int = 24
    breakout_lookback: int = 20
    zscore_lookback: int = 24
    zscore_scale: float = 1.5
    ma_weight: float = 0.40
    breakout_weight: float = 0.35
    contrarian_weight: float = 0.25
    momentum_lookback: int = 12
    momentum_scale: float = 0.006
    momentum_deadband: float = 0.0002
    reversion_scale: float = 0.006
    reversion_deadband: float = 0.0005


def trailing_log_return(w, k: int, price: str = "close") -> Column:
    """ln(P_t / P_{t-k}); before bar k the run's first bar is the start. Zero prices give infinite values or none that are numbers."""
    return ln(divide(F.col(price), F.first(price).over(rows(w, max(1, k)))))


def moving_average_signal(w, short: int, long: int, price: str = "close", ret: str = "_ret", floor: float | None = PRICE_EPS) -> Column:
    long_avg = F.avg(price).over(rows(w, long - 1))
    sigma = F.stddev_pop(ret).over(rows(w, long - 2))
    scale = F.greatest(F.coalesce(sigma, F.lit(0.0)) * float(max(1, short)) ** 0.5, F.lit(1e-8))
    gap = divide(F.avg(price).over(rows(w, short - 1)) - long_avg, long_avg if floor is None else F.greatest(long_avg, F.lit(floor)))
    return F.when(F.col("bar_index") >= long - 1, safe_tanh(gap / scale)).otherwise(F.lit(0.0))


def channel_breakout_signal(w, k: int, price: str = "close") -> Column:
    f = rows(w, k, -1)
    p, high, low = F.col(price), F.max(price).over(f), F.min(price).over(f)
    width = F.greatest(high - low, p * 1e-8)
    value = (
        F.when(p > high, clip(divide(p - high, width) * 4.0 + 0.55, 0.0, 1.0))
        .when(p < low, -clip(divide(low - p, width) * 4.0 + 0.55, 0.0, 1.0))
        .otherwise(clip((divide(p - low, width) - 0.5) * 0.30, -0.15, 0.15))
    )
    return F.when(F.col("bar_index") >= k, value).otherwise(F.lit(0.0))


def zscore_contrarian_signal(w, k: int, scale: float, price: str = "close") -> Column:
    f = rows(w, k - 1)
    mean, sd = F.avg(price).over(f), F.stddev_pop(price).over(f)
    flat = sd <= F.greatest(F.abs(mean) * 1e-15, F.lit(PRICE_EPS))
    return (
        F.when((F.col("bar_index") < k - 1) | flat, F.lit(0.0))
        .otherwise(-safe_tanh((F.col(price) - mean) / sd / scale))
    )


def deadband_tanh(value: Column, band: float, scale: float) -> Column:
    return F.when(F.abs(value) <= band, F.lit(0.0)).otherwise(safe_tanh((value - F.signum(value) * band) / scale))


def reversion_signal(price: Column, reference_value: Column, cfg: SignalConfig, floor: float | None = PRICE_EPS) -> Column:
    gap = divide(reference_value - price, price if floor is None else F.greatest(price, F.lit(floor)))
    return deadband_tanh(gap, cfg.reversion_deadband, cfg.reversion_scale)


def round_interval(price: Column, configured: float = 0.0) -> Column:
    if configured > 0:
        return F.lit(float(configured))
    p = F.greatest(price, F.lit(PRICE_EPS))
    # F.pow(10, -5) is not the double nearest to 1e-5, so the power is read from its decimal text.
    decade = F.concat(F.lit("1e"), F.floor(F.log10(p)).cast("string")).cast("double")
    return F.greatest(F.lit(PRICE_EPS), decade * 0.05)


def crossed_round_level(prev: Column, cur: Column, interval: Column) -> Column:
    low, high = F.least(prev, cur), F.greatest(prev, cur)
    level = F.ceil(low / interval) * interval
    tol = F.greatest(F.lit(PRICE_EPS), F.abs(interval) * 1e-12)
    moved = (prev > 0) & (cur > 0) & (prev != cur)
    return F.coalesce(moved & (level <= high + tol) & (F.abs(level - low) > tol), F.lit(False))


def round_level_signal(
    w,
    price: str = "close",
    *,
    cascade: float = 0.90,
    support: float = 0.45,
    proximity: float = 0.0018,
    configured: float = 0.0,
) -> tuple[Column, Column]:
    """(mode, signal) of stop cascades through, and support or resistance at, round prices."""
    cur, prev = F.col(price), F.lag(price).over(w)
    step = round_interval(cur, configured)
    direction = F.when((prev > 0) & (cur > 0), sign_eps(F.log(cur / prev))).when((prev == 0) & (cur > 0), F.lit(1.0)).otherwise(F.lit(0.0))
    nearest = F.rint(cur / step) * step
    near = F.abs(cur - nearest) / F.greatest(cur, F.lit(PRICE_EPS)) <= proximity
    mode = (
        F.when(prev.isNull(), F.lit("neutral"))
        .when(crossed_round_level(prev, cur, step), F.lit("stop_cascade"))
        .when(near & (direction > 0) & (cur <= nearest), F.lit("round_resistance"))
        .when(near & (direction < 0) & (cur >= nearest), F.lit("round_support"))
        .otherwise(F.lit("neutral"))
    )
    signal = (
        F.when(mode == "stop_cascade", direction * cascade)
        .when(mode == "round_resistance", F.lit(-support))
        .when(mode == "round_support", F.lit(support))
        .otherwise(F.lit(0.0))
    )
    return mode, signal


def rule_signals(bars: DataFrame, cfg: SignalConfig = SignalConfig(), floor: float | None = PRICE_EPS) -> DataFrame:
    """Moving-average, breakout and contrarian signals and their weighted blend.

    The long average counts as at least ``floor`` and changes from or to a price of zero do not count; without one, an average of zero gives
    no number, which the signal cuts to 1.
    """
    weight = cfg.ma_weight + cfg.breakout_weight + cfg.contrarian_weight

    def build(w):
        before = F.lag("close").over(w)
        change = ln(divide(F.col("close"), before))
        return [
            {"_ret": change if floor is None else F.when((F.col("close") > 0) & (before > 0), change)},
            {
                "ma_signal": moving_average_signal(w, cfg.short_ma, cfg.long_ma, floor=floor),
                "breakout_signal": channel_breakout_signal(w, cfg.breakout_lookback),
                "contrarian_signal": zscore_contrarian_signal(w, cfg.zscore_lookback, cfg.zscore_scale),
            },
            {
                "rule_signal": (
                    cfg.ma_weight * F.col("ma_signal")
                    + cfg.breakout_weight * F.col("breakout_signal")
                    + cfg.contrarian_weight * F.col("contrarian_signal")
                ) / weight
            },
        ]

    reach = max(cfg.long_ma, cfg.breakout_lookback, cfg.zscore_lookback) + 1
    return over_halo(bars, reach, build).drop("_ret")


def momentum_signal(bars: DataFrame, cfg: SignalConfig = SignalConfig()) -> DataFrame:
    def build(w):
        return [
            {"trailing_return": trailing_log_return(w, cfg.momentum_lookback)},
            {"momentum_signal": deadband_tanh(F.col("trailing_return"), cfg.momentum_deadband, cfg.momentum_scale)},
        ]

    return over_halo(bars, cfg.momentum_lookback, build)


REGIMES = {
    # fixed values: regime -> (drift, volatility multiplier, liquidity multiplier, signal)
    "neutral": (0.0, 1.0, 1.0, 0.0),
    "trend_up": (0.00009, 1.15, 1.0, 0.85),
    "trend_down": (-0.00009, 1.15, 1.0, -0.85),
    "mean_reverting": (0.0, 0.85, 1.0, 0.0),
    "high_volatility": (0.0, 3.0, 0.70, 0.0),
    "panic": (-0.00025, 2.4, 0.45, -0.85),
    "euphoria": (0.000175, 1.8, 0.75, 0.85),
}


def regime_profile(regime: Column) -> dict[str, Column]:
    """Multipliers of a regime label as literal lookups (seven fixed rows, no join needed)."""
    names = ("drift_fraction", "volatility_multiplier", "liquidity_multiplier", "regime_signal")
    out = {}
    for i, name in enumerate(names):
        pairs = [F.lit(x) for k, v in REGIMES.items() for x in (k, float(v[i]))]
        default = F.lit(float(REGIMES["neutral"][i]))
        out[name] = F.coalesce(F.create_map(*pairs)[regime], default)
    return out


def blend_signals(signal: Column, weight: Column, multiplier: Column) -> dict[str, Column]:
    """Aggregates over component rows: clipped weighted mean and weighted geometric mean."""
    total = F.sum(weight)
    return {
        "aggregate_signal": clip(F.sum(weight * signal) / total, -1.0, 1.0),
        "geometric_multiplier": F.exp(F.sum(weight * F.log(F.greatest(multiplier, F.lit(PRICE_EPS)))) / total),
    }


def signal_events(
    bars: DataFrame, *, channel: int = 120, z_bars: int = 24, z_high: float = 3.2, z_confirm: float = 4.0, z_low: float = -1.2
) -> DataFrame:
    """Events from plain price rules, in the shape of detector events.

    A close outside the prior channel is a confirmed rectangle break; a stretched z-score is a double
    top (confirmed only when extreme) or double bottom. Families may contradict each other on a bar.
    """

    def build(w):
        recent = rows(w, z_bars - 1)
        z = F.try_divide(F.col("close") - F.avg("close").over(recent), F.stddev_pop("close").over(recent))
        return [
            *sliding_extremes(w, channel, 1, {"_hi": ("max", "close"), "_lo": ("min", "close")}),
            {"_z": F.when(F.col("bar_index") >= z_bars - 1, z)},
        ]

    x = over_halo(bars.select("run_id", "bar_index", "close"), channel, build)
    full = F.col("bar_index") >= channel
    up, down = full & (F.col("close") > F.col("_hi")), full & (F.col("close") < F.col("_lo"))

    def event(cond, name, confirmed, side, fit):
        return F.when(cond, F.struct(
            F.lit(name).alias("pattern_name"), confirmed.alias("breakout_confirmed"),
            F.when(confirmed, side).alias("breakout_direction"), F.round(fit, 4).alias("geometry_fit_score")))

    yes = F.lit(True)
    gap = F.when(up, F.col("close") / F.col("_hi") - 1).otherwise(1 - F.col("close") / F.col("_lo"))
    found = F.array_compact(F.array(
        event(up | down, "rectangle", yes, F.when(up, "bullish").otherwise("bearish"), F.least(F.lit(1.0), gap)),
        event(F.col("_z") > z_high, "double_top", F.col("_z") > z_confirm, F.lit("bearish"), F.least(F.lit(1.0), F.col("_z") / 5)),
        event(F.col("_z") < z_low, "double_bottom", yes, F.lit("bullish"), F.least(F.lit(1.0), -F.col("_z") / 5)),
    ))
    e = x.filter(F.size(found) > 0).select("run_id", "bar_index", F.explode(found).alias("e"))
    return e.select(
        "run_id",
        F.concat_ws("-", F.lit("EV"), "run_id", F.col("bar_index").cast("string"), F.col("e.pattern_name")).alias("event_id"),
        "e.pattern_name", F.col("bar_index").alias("available_at_index"),
        (F.col("bar_index") - 20).alias("start_index"), (F.col("bar_index") - 2).alias("end_index"),
        F.lit(43).alias("observation_window_length"), F.lit(35).alias("core_window_length"),
        "e.geometry_fit_score", "e.breakout_confirmed", "e.breakout_direction",
        (F.col("bar_index") + 1).alias("entry_index"),
    )
