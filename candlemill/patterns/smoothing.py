"""Rolling windows, ensemble smoothing and extrema: the one step that needs arrays in a task.

A series is cut into chunks with a halo of one observation length; every chunk is independent, so a
hot run spreads over all tasks. Inside a chunk the work is a few matrix products and column-wise
passes over all windows at once. Only windows that can still hold a fresh pattern leave the task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from candlemill.config import GEOMETRY_FLOOR, PatternConfig
from candlemill.functions.windows import spread_chunks, spread_halo
from candlemill.operators.features import relative_log_price

PIVOT = T.StructType([
    T.StructField("idx", T.IntegerType()),
    T.StructField("raw_idx", T.IntegerType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("raw_value", T.DoubleType()),
    T.StructField("is_max", T.BooleanType()),
    T.StructField("prominence", T.DoubleType()),
])

WINDOW_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("core_length", T.IntegerType()),
    T.StructField("window_end", T.LongType()),
    T.StructField("noise", T.DoubleType()),
    T.StructField("pivots", T.ArrayType(PIVOT)),
    T.StructField("tail", T.ArrayType(T.DoubleType())),
])

MAD_SCALE = 1.4826
DETECT_CHUNK = 2048  # bars per task unit; the halo of one window costs about 5%
BREAKOUT_LOOKBACK = 10


def smoother(length: int, bandwidth: float) -> np.ndarray:
    """Row-normalised weights of a Gaussian local-linear fit at every position."""
    d = np.arange(length)[None, :] - np.arange(length)[:, None].astype(float)
    k = np.exp(-0.5 * (d / bandwidth) ** 2)
    m0, m1, m2 = (np.sum(k * d**p, axis=1, keepdims=True) for p in (0, 1, 2))
    det = m0 * m2 - m1 * m1
    linear = k * (m2 - m1 * d) / np.where(det > 1e-12, det, 1.0)
    rows = np.where(det > 1e-12, linear, k / m0)
    return rows / rows.sum(axis=1, keepdims=True)


def tail_length(config: PatternConfig, core: int) -> int:
    """Raw values that the breakout search and its volatility can reach back to."""
    return config.max_age(core) + config.context(core) + BREAKOUT_LOOKBACK + 1


def smooth_windows(windows: np.ndarray, bandwidths: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Pointwise median of the smooths, and the robust residual noise of each window."""
    length = windows.shape[1]
    curves = np.stack([windows @ smoother(length, b).T for b in bandwidths])
    smooth = np.median(curves, axis=0)
    res = windows - smooth
    res -= np.median(res, axis=1, keepdims=True)
    return smooth, MAD_SCALE * np.median(np.abs(res), axis=1)


def prominence(smooth: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Height over the higher side minimum and depth under the lower side maximum, per position."""
    n, length = smooth.shape
    pad = np.full((n, reach), np.nan)
    wide = np.concatenate([pad, smooth, pad], axis=1)
    at = lambda k: wide[:, reach + k: reach + k + length]
    left = [at(-k) for k in range(1, reach + 1)]
    right = [at(k) for k in range(1, reach + 1)]
    lo = lambda xs: np.fmin.reduce(xs)
    hi = lambda xs: np.fmax.reduce(xs)
    up = smooth - np.maximum(lo(left), lo(right))
    down = np.minimum(hi(left), hi(right)) - smooth
    return np.maximum(up, 0.0), np.maximum(down, 0.0)


def thin_pivots(kind, idx, value, prom, rows, n_rows, gap):
    """Alternation rules over all windows at once: one pass per candidate rank.

    Same kind as the last pivot: the more extreme one stays. Opposite kind within ``gap`` bars: the
    more prominent one stays. A second pass restores strict alternation. Returns, per window, the
    positions (into the candidate arrays) that survive.
    """
    first = np.searchsorted(rows, np.arange(n_rows))
    count = np.bincount(rows, minlength=n_rows)
    width = int(count.max()) if len(rows) else 0
    kept = np.full((n_rows, max(width, 1)), -1, dtype=np.int64)
    size = np.zeros(n_rows, dtype=np.int64)

    def more_extreme(new, old):
        return np.where(kind[new], value[new] > value[old], value[new] < value[old])

    for k in range(width):
        w = np.flatnonzero(count > k)
        c = first[w] + k
        top = size[w] - 1
        has = top >= 0
        last = np.where(has, kept[w, np.maximum(top, 0)], c)
        same = has & (kind[c] == kind[last])
        close = has & ~same & (idx[c] - idx[last] < gap)
        swap = (same & more_extreme(c, last)) | (close & (prom[c] > prom[last]))
        kept[w[swap], top[swap]] = c[swap]
        new = ~same & ~close
        kept[w[new], size[w[new]]] = c[new]
        size[w[new]] += 1
    out = np.full_like(kept, -1)
    n_out = np.zeros(n_rows, dtype=np.int64)
    for k in range(int(size.max()) if n_rows else 0):
        w = np.flatnonzero(size > k)
        c = kept[w, k]
        top = n_out[w] - 1
        has = top >= 0
        last = np.where(has, out[w, np.maximum(top, 0)], c)
        same = has & (kind[c] == kind[last])
        swap = same & more_extreme(c, last)
        out[w[swap], top[swap]] = c[swap]
        new = ~same
        out[w[new], n_out[w[new]]] = c[new]
        n_out[w[new]] += 1
    return out, n_out


def window_pivots(windows: np.ndarray, config: PatternConfig, core: int):
    """Noise and surviving pivots of every window of one scale."""
    smooth, noise = smooth_windows(windows, config.bandwidths(core))
    slope = np.diff(smooth, axis=1)
    left, right = slope[:, :-1], slope[:, 1:]
    is_max = (left >= 0) & (right < 0)
    is_min = (left <= 0) & (right > 0) & ~is_max
    up, down = prominence(smooth, config.prominence_lookaround)
    floor = np.maximum(GEOMETRY_FLOOR, config.prominence_noise_scale * noise)[:, None]
    height = np.where(is_max, up[:, 1:-1], down[:, 1:-1])
    rows, pos = np.nonzero((is_max | is_min) & (height >= floor))
    kind, idx = is_max[rows, pos], pos + 1
    prom = height[rows, pos]
    value = smooth[rows, idx]
    kept, size = thin_pivots(kind, idx, value, prom, rows, len(windows), config.min_pivot_separation)
    r = config.pivot_refine_radius
    raw = idx.copy()
    best = None
    for shift in range(-r, r + 1):
        j = idx + shift
        ok = (j >= 0) & (j < windows.shape[1])
        v = np.where(ok, windows[rows, np.clip(j, 0, windows.shape[1] - 1)], np.nan)
        v = np.where(kind, v, -v)
        if best is None:
            best, raw = v, j
        else:
            better = ok & (np.isnan(best) | (v > best))
            best, raw = np.where(better, v, best), np.where(better, j, raw)
    return noise, kept, size, {
        "idx": idx, "raw": raw, "value": value, "raw_value": windows[rows, raw] if len(rows) else value,
        "is_max": kind, "prom": prom,
    }


def _may_hold_pattern(kept, size, idx, core, config):
    """Windows with three consecutive pivots inside the core that end fresh enough."""
    lead = config.context(core)
    last = lead + core - 1
    col = np.arange(kept.shape[1])
    at = np.where(kept >= 0, idx[np.maximum(kept, 0)] if len(idx) else 0, -1)
    if kept.shape[1] < 3:
        return np.zeros(len(kept), dtype=bool)
    end, start = at[:, 2:], at[:, :-2]
    live = col[None, 2:] < size[:, None]
    return (live & (start >= lead) & (end <= last) & (last - end <= config.max_age(core))).any(axis=1)


def chunk_windows(pdf: pd.DataFrame, config: PatternConfig, every: bool = False) -> pd.DataFrame:
    pdf = pdf.sort_values("bar_index", kind="mergesort")
    x = pdf["rel_log"].to_numpy(dtype=float)
    bar = pdf["bar_index"].to_numpy()
    core_row = pdf["_core"].to_numpy()
    run = pdf["run_id"].iloc[0]
    parts = []
    for core in config.core_lengths:
        length = config.observation_length(core)
        if len(x) < length:
            continue
        ends = np.arange(length - 1, len(x))
        ends = ends[core_row[length - 1:]]
        windows = np.lib.stride_tricks.sliding_window_view(x, length)[ends - length + 1]
        for lo in range(0, len(ends), 2048):
            block, block_ends = windows[lo: lo + 2048], ends[lo: lo + 2048]
            noise, kept, size, c = window_pivots(block, config, core)
            keep = np.arange(len(block)) if every else np.flatnonzero(_may_hold_pattern(kept, size, c["idx"], core, config))
            if not len(keep):
                continue
            tail = tail_length(config, core)
            parts.append(pd.DataFrame({
                "run_id": run, "core_length": np.int32(core), "window_end": bar[block_ends[keep]],
                "noise": noise[keep],
                "pivots": [
                    [
                        {"idx": int(c["idx"][i]), "raw_idx": int(c["raw"][i]), "value": float(c["value"][i]),
                         "raw_value": float(c["raw_value"][i]), "is_max": bool(c["is_max"][i]),
                         "prominence": float(c["prom"][i])}
                        for i in kept[w, : size[w]]
                    ]
                    for w in keep
                ],
                "tail": [block[w, -tail:] for w in keep],
            }))
    if not parts:
        return pd.DataFrame(columns=WINDOW_SCHEMA.names)
    return pd.concat(parts, ignore_index=True)


def pivot_windows(bars: DataFrame, config: PatternConfig = PatternConfig(), *, chunk: int = DETECT_CHUNK, every: bool = False) -> DataFrame:
    """Windows of every scale with their noise, pivots and raw tail, known at ``window_end``: those that can still hold a fresh
    pattern, or ``every`` one."""
    rel = relative_log_price(bars).select("run_id", "bar_index", "rel_log")
    halo = spread_halo(rel, config.warmup_bars - 1, chunk=chunk)
    return spread_chunks(halo, "run_id", "_chunk").groupBy("run_id", "_chunk").applyInPandas(lambda pdf: chunk_windows(pdf, config, every), WINDOW_SCHEMA)


SMOOTH_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("core_length", T.IntegerType()),
    T.StructField("window_end", T.LongType()),
    T.StructField("noise", T.DoubleType()),
    T.StructField("smooth_middle", T.DoubleType()),
    T.StructField("smooth_end", T.DoubleType()),
])


def chunk_smooths(pdf: pd.DataFrame, config: PatternConfig) -> pd.DataFrame:
    pdf = pdf.sort_values("bar_index", kind="mergesort")
    x, bar, own = pdf["rel_log"].to_numpy(dtype=float), pdf["bar_index"].to_numpy(), pdf["_core"].to_numpy()
    parts = []
    for core in config.core_lengths:
        length = config.observation_length(core)
        if len(x) >= length:
            ends = np.arange(length - 1, len(x))[own[length - 1:]]
            smooth, noise = smooth_windows(np.lib.stride_tricks.sliding_window_view(x, length)[ends - length + 1], config.bandwidths(core))
            parts.append(pd.DataFrame({
                "run_id": pdf["run_id"].iloc[0], "core_length": np.int32(core), "window_end": bar[ends], "noise": noise,
                "smooth_middle": smooth[:, length // 2], "smooth_end": smooth[:, -1]}))
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=SMOOTH_SCHEMA.names)


def smoothed_windows(bars: DataFrame, config: PatternConfig = PatternConfig(), *, chunk: int = DETECT_CHUNK) -> DataFrame:
    """Noise, middle and end of the smooth of every rolling window of every scale."""
    rel = relative_log_price(bars).select("run_id", "bar_index", "rel_log")
    halo = spread_halo(rel, config.warmup_bars - 1, chunk=chunk)
    return spread_chunks(halo, "run_id", "_chunk").groupBy("run_id", "_chunk").applyInPandas(lambda pdf: chunk_smooths(pdf, config), SMOOTH_SCHEMA)


def window_index(bars: DataFrame, config: PatternConfig = PatternConfig()) -> DataFrame:
    """The rolling windows themselves: one row per scale and bar at which a window is complete."""
    scale = F.explode(F.array(*[
        F.struct(F.lit(c).alias("core_length"), F.lit(config.observation_length(c)).alias("observation_length")) for c in config.core_lengths]))
    return (
        bars.select("run_id", F.col("bar_index").alias("window_end"), scale.alias("s"))
        .select("run_id", "s.core_length", "s.observation_length", "window_end")
        .filter(F.col("window_end") >= F.col("observation_length") - 1)
        .withColumn("window_start", F.col("window_end") - F.col("observation_length") + 1)
    )
