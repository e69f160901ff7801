"""Structured Streaming forms of bars, detection, the position guard and run metrics.

A key's share of one micro-batch is sorted in one task. Bound it on the source
(``maxFilesPerTrigger`` or the like); between batches only the small state of a key is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from candlemill.config import PatternConfig
from candlemill.patterns.smoothing import _may_hold_pattern, window_pivots
from candlemill.session import scratch_path


def read_table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def ordered_batches(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Numbered rows as a stream whose micro-batches hold at most ``size`` rows of a run, earlier steps first.

    The rows are cut by ``step`` once; the cuts then become one file each, written one after the other, as a file stream
    goes by the age of its files.
    """
    spark = rows.sparkSession
    cut, inbox = scratch_path(spark, f"{name}-cut"), scratch_path(spark, name)
    rows.withColumn("_batch", F.floor(F.col("step") / size).cast("long")).write.partitionBy("_batch").parquet(cut)
    whole = spark.read.parquet(cut)
    schema = whole.drop("_batch").schema
    for (batch,) in whole.select("_batch").distinct().orderBy("_batch").collect():  # one small row for each micro-batch
        spark.read.schema(schema).parquet(f"{cut}/_batch={batch}").coalesce(1).write.mode("append").parquet(inbox)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox)


def run_to_end(stream: DataFrame, name: str, checkpoint: str | None = None, path: str | None = None) -> DataFrame:
    """Process what is available into an idempotent file sink and read the result back."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, f"stream-{name}")
    checkpoint = checkpoint or scratch_path(spark, f"progress-{name}")
    q = stream.writeStream.outputMode("append").format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def time_bars(ticks: DataFrame, width: str, delay: str) -> DataFrame:
    """Complete time bars only: a bar appears once the watermark has passed its end; ticks later than
    the delay are dropped."""
    g = ticks.withWatermark("ts", delay).groupBy(F.window("ts", width), "run_id")
    return g.agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "ts").alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("ticks"),
    ).select("run_id", F.col("window.start").alias("bar_start"), "open", "high", "low", "close", "volume", "ticks")


BAR_SCHEMA = "run_id string, bar_index long, open double, high double, low double, close double, volume long"
BAR_STATE = "next_bar long, prices array<double>, volumes array<long>"


def count_bars(ticks: DataFrame, n: int) -> DataFrame:
    """Fixed-count bars; the state of a run is its next bar number and at most n-1 waiting ticks."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bar, prices, volumes = state.get if state.exists else (0, [], [])
        new = pd.concat(list(frames), ignore_index=True).sort_values(["ts", "event_id"])
        p = np.concatenate([np.asarray(prices, dtype=float), new["price"].to_numpy(dtype=float)])
        v = np.concatenate([np.asarray(volumes, dtype=np.int64), new["volume"].to_numpy(dtype=np.int64)])
        full = len(p) // n
        state.update((int(bar + full), p[full * n:].tolist(), v[full * n:].tolist()))
        if full:
            pp, vv = p[: full * n].reshape(full, n), v[: full * n].reshape(full, n)
            yield pd.DataFrame({
                "run_id": key[0], "bar_index": bar + np.arange(full), "open": pp[:, 0], "high": pp.max(axis=1),
                "low": pp.min(axis=1), "close": pp[:, -1], "volume": vv.sum(axis=1)})

    return ticks.select("run_id", "ts", "event_id", "price", "volume").groupBy("run_id").applyInPandasWithState(
        step, BAR_SCHEMA, BAR_STATE, "append", GroupStateTimeout.NoTimeout)


SHAPE_SCHEMA = "run_id string, core_length int, window_end long, noise double, pivots int, last_pivot string"
SHAPE_STATE = "seen long, base double, recent array<double>"


def detect_shapes(bars: DataFrame, config: PatternConfig = PatternConfig()) -> DataFrame:
    """Fresh pivot windows at availability; the state of a run is its first price and last bars."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, base, recent = state.get if state.exists else (0, None, [])
        new = pd.concat(list(frames), ignore_index=True).sort_values(["ts", "event_id"])["close"].to_numpy(dtype=float)
        base = float(np.log(new[0])) if base is None else base
        x = np.concatenate([np.asarray(recent, dtype=float), np.log(new) - base])
        first = seen - len(recent)
        state.update((int(seen + len(new)), base, x[-(config.warmup_bars - 1):].tolist()))
        for core in config.core_lengths:
            length = config.observation_length(core)
            ends = np.arange(max(length - 1, len(recent)), len(x))
            if not len(ends):
                continue
            windows = np.lib.stride_tricks.sliding_window_view(x, length)[ends - length + 1]
            for lo in range(0, len(ends), 2048):
                noise, kept, size, c = window_pivots(windows[lo: lo + 2048], config, core)
                keep = np.flatnonzero(_may_hold_pattern(kept, size, c["idx"], core, config))
                last = [bool(c["is_max"][kept[w, size[w] - 1]]) for w in keep]
                yield pd.DataFrame({
                    "run_id": key[0], "core_length": np.int32(core), "window_end": first + ends[lo: lo + 2048][keep],
                    "noise": noise[keep], "pivots": size[keep].astype(np.int32),
                    "last_pivot": ["max" if m else "min" for m in last]})

    return bars.select("run_id", "ts", "event_id", "close").groupBy("run_id").applyInPandasWithState(
        step, SHAPE_SCHEMA, SHAPE_STATE, "append", GroupStateTimeout.NoTimeout)


GUARD_SCHEMA = "run_id string, hypothesis string, event_id string, entry_index long, exit_index long, accepted boolean"


def position_guard(signals: DataFrame) -> DataFrame:
    """Skip new signals while a position is open; the state is one number per key."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_until = state.get[0] if state.exists else -1
        s = pd.concat(list(frames), ignore_index=True).sort_values("entry_index")
        taken = []
        for entry, exit_ in zip(s["entry_index"], s["exit_index"]):
            ok = entry > open_until
            open_until = exit_ if ok else open_until
            taken.append(bool(ok))
        state.update((int(open_until),))
        yield pd.DataFrame({
            "run_id": key[0], "hypothesis": key[1], "event_id": s["event_id"], "entry_index": s["entry_index"],
            "exit_index": s["exit_index"], "accepted": taken})

    return signals.select("run_id", "hypothesis", "event_id", "entry_index", "exit_index").groupBy("run_id", "hypothesis").applyInPandasWithState(
        step, GUARD_SCHEMA, "open_until long", "append", GroupStateTimeout.NoTimeout)


def run_metrics_stream(rows: DataFrame, name: str) -> DataFrame:
    """Mergeable run metrics kept up to date; each trigger replaces the small result table."""
    spark = rows.sparkSession
    path = scratch_path(spark, f"stream-{name}")
    agg = rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("trades"), F.sum("net_directional_return").alias("net_return"), F.avg("profitable").alias("success_rate"))

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    q = agg.writeStream.outputMode("complete").option("checkpointLocation", scratch_path(spark, f"progress-{name}")).foreachBatch(
        replace).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(agg.schema).parquet(path)


def sessions(signals: DataFrame, gap: str, delay: str) -> DataFrame:
    """Signals of a run grouped into sessions that end after a quiet gap."""
    g = signals.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "run_id")
    return g.agg(F.count(F.lit(1)).alias("signals"), F.sum("volume").alias("volume")).select(
        "run_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "signals", "volume")
