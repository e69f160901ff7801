"""Decayed recursions over a series.

A decayed state forgets: after ``burn`` bars the weight of the unknown start is below double
precision. Each chunk is therefore folded on its own after a burn-in over the bars before it, so a
long series is processed in parallel and no task holds a whole run.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from candlemill.functions.windows import over_halo, spread_chunks, spread_halo


@dataclass(frozen=True)
class MoodConfig:
    # fixed values: defaults of the mood recursion
    decay: float = 0.90
    return_scale: float = 0.0015
    fomo_sensitivity: float = 0.22
    fear_sensitivity: float = 0.25
    greed_sensitivity: float = 0.12
    drawdown_sensitivity: float = 0.035
    drawdown_scale: float = 0.05
    signal_scale: float = 1.20
    peak_bars: int = 128
    trend_bars: int = 8
    ceiling: float = 8.0


@dataclass(frozen=True)
class ScoreConfig:
    # fixed values: defaults of the strategy-score recursion
    decay: float = 0.965
    learning_rate: float = 0.16
    return_scale: float = 0.0015
    temperature: float = 0.35
    exploration: float = 0.05


def burn_in(decay: float) -> int:
    """Bars after which the start value weighs less than 1e-30."""
    return 0 if decay <= 0 else int(math.ceil(math.log(1e-30) / math.log(decay)))


def decayed_states(
    df: DataFrame, inputs: dict[str, str], decay: float, *, ceiling: float | None = None, index: str = "bar_index"
) -> DataFrame:
    """state_t = min(decay * state_{t-1} + input_t, ceiling), starting from 0, for several inputs."""
    burn = burn_in(decay)
    keep = [c for c in df.columns]
    wide = spread_halo(df, burn, index=index)
    schema = df.schema
    for name in inputs:
        schema = schema.add(name, "double")
    cap = math.inf if ceiling is None else float(ceiling)
    sources, names = list(inputs.values()), list(inputs)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index, kind="mergesort")
        x = pdf[sources].to_numpy(dtype=float)
        out = np.empty_like(x)
        state = np.zeros(x.shape[1])
        for i in range(len(x)):
            state = np.minimum(decay * state + x[i], cap)
            out[i] = state
        pdf[names] = out
        return pdf.loc[pdf["_core"], keep + names]

    return spread_chunks(wide, "run_id", "_chunk").groupBy("run_id", "_chunk").applyInPandas(fold, schema)


def mood(bars: DataFrame, cfg: MoodConfig = MoodConfig()) -> DataFrame:
    """Fear, fomo and greed states and the sentiment index of a price series."""

    def build(w):
        ret = F.coalesce(F.log(F.col("close") / F.lag("close").over(w)), F.lit(0.0))
        peak = F.max("close").over(w.rowsBetween(-(cfg.peak_bars - 1), 0))
        start = F.first("close").over(w.rowsBetween(-cfg.trend_bars, 0))
        trend = F.greatest(F.log(F.col("close") / start), F.lit(0.0)) / (cfg.return_scale * 4.0)
        drop = F.greatest(F.lit(0.0), 1.0 - F.col("close") / peak)
        return [
            {"_r": ret, "_drop": drop, "_trend": trend},
            {
                "_up": cfg.fomo_sensitivity * F.greatest(F.col("_r"), F.lit(0.0)) / cfg.return_scale,
                "_down": cfg.fear_sensitivity * F.greatest(-F.col("_r"), F.lit(0.0)) / cfg.return_scale
                + cfg.drawdown_sensitivity * F.col("_drop") / cfg.drawdown_scale,
                "_greed": cfg.greed_sensitivity * F.col("_trend"),
            },
        ]

    x = over_halo(bars, cfg.peak_bars, build).select("run_id", "bar_index", "_up", "_down", "_greed")
    s = decayed_states(x, {"fomo": "_up", "fear": "_down", "greed": "_greed"}, cfg.decay, ceiling=cfg.ceiling)
    index = F.tanh((F.col("fomo") + 0.65 * F.col("greed") - F.col("fear")) / cfg.signal_scale)
    return s.select("run_id", "bar_index", "fomo", "fear", "greed", index.alias("sentiment"))


def strategy_weights(bars: DataFrame, signals: list[str], cfg: ScoreConfig = ScoreConfig()) -> DataFrame:
    """Decayed score of each strategy (previous signal times scaled return) and softmax weights."""

    def build(w):
        ret = F.coalesce(F.log(F.col("close") / F.lag("close").over(w)), F.lit(0.0)) / cfg.return_scale
        scaled = F.least(F.greatest(ret, F.lit(-5.0)), F.lit(5.0))
        return {
            f"_rw_{s}": cfg.learning_rate * F.coalesce(F.lag(s).over(w), F.lit(0.0)) * scaled for s in signals
        }

    x = over_halo(bars, 1, build).select("run_id", "bar_index", *[f"_rw_{s}" for s in signals])
    out = decayed_states(x, {f"score_{s}": f"_rw_{s}" for s in signals}, cfg.decay)
    top = F.greatest(*[F.col(f"score_{s}") for s in signals]) / cfg.temperature
    power = {s: F.exp(F.greatest(F.col(f"score_{s}") / cfg.temperature - top, F.lit(-700.0))) for s in signals}
    total = sum(power.values(), F.lit(0.0))
    return out.select(
        "run_id", "bar_index",
        *[F.col(f"score_{s}") for s in signals],
        *[(power[s] / total).alias(f"weight_{s}") for s in signals],
    )
