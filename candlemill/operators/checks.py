"""Validation predicates. Each returns the violating rows; ``require_none`` raises on the first."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from candlemill.functions.windows import over_halo


def require_none(violations: DataFrame, message: str) -> None:
    row = violations.head()
    if row is not None:
        raise ValueError(f"{message}: {row.asDict()}")


def _bad(ok: Column) -> Column:
    return ~F.coalesce(ok, F.lit(False))


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))


def ohlc_ok(tolerance: Column | None = None) -> Column:
    """Finite positive OHLC with high and low on the right sides, within a relative tolerance."""
    names = ("open", "high", "low", "close")
    top = F.greatest(*names)
    tol = top * 1e-12 if tolerance is None else tolerance
    ok = (F.col("high") + tol >= F.greatest("open", "close", "low")) & (F.col("low") - tol <= F.least("open", "close", "high"))
    for n in names:
        ok = ok & _finite(n) & (F.col(n) > 0)
    return ok


def bad_tick_bars(ticks: DataFrame) -> DataFrame:
    """V1: tick OHLC and volume; a missing OHLC field falls back to the trade price first."""
    filled = ticks.withColumns({c: F.coalesce(F.col(c), F.col("price")) for c in ("open", "high", "low", "close")})
    return filled.filter(_bad(ohlc_ok() & (F.col("step") >= 0) & (F.col("volume") >= 0)))


def broken_sequence(df: DataFrame, index: str, value: str, *, contiguous: bool = True) -> DataFrame:
    """V2: rows whose value does not increase (by exactly one when contiguous) along ``index``."""
    x = over_halo(df, 1, lambda w: {"_prev": F.lag(value).over(w)}, index=index)
    ok = (F.col(value) == F.col("_prev") + 1) if contiguous else (F.col(value) > F.col("_prev"))
    return x.filter(F.col("_prev").isNotNull() & _bad(ok))


def bad_candles(bars: DataFrame) -> DataFrame:
    """V3: candle fields, numbering, and overlap with the candle before."""
    x = over_halo(bars, 1, lambda w: {"_end": F.lag("end_step").over(w), "_num": F.lag("candle_number").over(w)})
    fields = ohlc_ok() & (F.col("candle_number") >= 1) & (F.col("start_step") >= 0) & (F.col("end_step") >= F.col("start_step")) & (F.col("volume") >= 0)
    order = (F.col("_num").isNull() | (F.col("candle_number") > F.col("_num"))) & (F.col("_end").isNull() | (F.col("start_step") > F.col("_end")))
    return x.filter(_bad(fields & order))


def partial_columns(bars: DataFrame, columns: Sequence[str] = ("open", "high", "low", "volume")) -> DataFrame:
    """V4: runs where an optional column is present on some bars only, or one of high/low is missing."""
    g = bars.groupBy("run_id").agg(F.count(F.lit(1)).alias("bars"), *[F.count(c).alias(f"n_{c}") for c in columns])
    ok = F.lit(True)
    for c in columns:
        ok = ok & ((F.col(f"n_{c}") == 0) | (F.col(f"n_{c}") == F.col("bars")))
    if {"high", "low"} <= set(columns):
        ok = ok & ((F.col("n_high") > 0) == (F.col("n_low") > 0))
    return g.filter(_bad(ok))


def bad_detector_rows(bars: DataFrame) -> DataFrame:
    """V4: close positive and finite; OHLC relations within 16 machine epsilons of the scale."""
    tol = F.greatest("open", "high", "low", "close") * 16 * 2.220446049250313e-16
    return bars.filter(_bad(ohlc_ok(tol)))


LABELS = ("timestamp", "datetime", "time", "date", "start_step", "candle_number")


def label_column(columns: Sequence[str]) -> str | None:
    """V5: the first label column present, in order of preference."""
    return next((c for c in LABELS if c in columns), None)


def bad_labels(bars: DataFrame) -> DataFrame:
    """V5: labels must be complete and strictly increasing."""
    name = label_column(bars.columns)
    if name is None:
        return bars.limit(0)
    x = over_halo(bars, 1, lambda w: {"_prev": F.lag(name).over(w)})
    return x.filter(F.col(name).isNull() | (F.col("_prev").isNotNull() & _bad(F.col(name) > F.col("_prev"))))


_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}  # fixed values


def timeframe_seconds(label: str) -> float:
    """Seconds of a fixed-duration label such as 15m or 1d; calendar months are refused."""
    parts = re.fullmatch(r"0*([1-9][0-9]*)([smhdw])", label.strip())
    if parts is None:
        raise ValueError(f"not a fixed duration: {label!r}")
    return float(int(parts[1]) * _UNITS[parts[2]])


def irregular_spacing(bars: DataFrame, time: str = "ts", timeframe: str | None = None) -> DataFrame:
    """V6: runs whose gaps are not all equal, positive and equal to the declared timeframe."""
    x = over_halo(bars, 1, lambda w: {"_gap": (F.unix_micros(time) - F.lag(F.unix_micros(time)).over(w)) / 1e6})
    g = x.groupBy("run_id").agg(F.min("_gap").alias("min_gap"), F.max("_gap").alias("max_gap"), F.count(F.lit(1)).alias("bars"))
    ok = (F.col("bars") >= 2) & (F.col("min_gap") > 0) & (F.col("max_gap") - F.col("min_gap") <= 1e-6)
    if timeframe is not None:
        ok = ok & (F.abs(F.col("min_gap") - timeframe_seconds(timeframe)) <= 1e-6)
    return g.filter(_bad(ok))


def bad_csv_rows(parsed: DataFrame) -> DataFrame:
    """V7: parsed CSV rows with unreadable numbers or times, impossible OHLC, volume or quotes."""
    ok = ohlc_ok(F.lit(0.0)) & F.col("ts").isNotNull() & (F.col("volume") >= 0)
    if "open_bid" in parsed.columns:
        for side in ("open", "close"):
            ok = ok & (F.col(f"{side}_bid") > 0) & (F.col(f"{side}_ask") >= F.col(f"{side}_bid"))
    return parsed.filter(_bad(ok))


def bad_specs(specs: DataFrame) -> DataFrame:
    """V8: dataset declarations outside the supported policies."""
    basis = ((F.col("price_basis") == "raw") & (F.col("corporate_action_policy") == "none_in_window")) | (
        (F.col("price_basis") == "adjusted") & (F.col("corporate_action_policy") == "fully_adjusted"))
    named = F.lit(True)
    for c in ("asset", "venue", "timeframe"):
        named = named & (F.length(F.trim(c)) > 0)
    fixed = F.col("timeframe").rlike(r"^0*[1-9][0-9]*[smhdw]$")
    return specs.filter(_bad(basis & named & fixed & (F.col("session_policy") == "continuous") & (F.col("timestamp_semantics") == "bar_open")))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def early_entries(events: DataFrame) -> DataFrame:
    """Entries not after the bar at which the signal became known."""
    return events.filter(_bad(F.col("entry_index") > F.col("available_at_index")))


def universe_conflicts(universe: DataFrame, rows: DataFrame) -> DataFrame:
    """Repeated runs, structures with two families, rows that disagree with the universe."""
    repeated = duplicate_keys(universe, ["run_id"]).select(F.col("run_id").alias("key"), F.lit("repeated run").alias("problem"))
    families = universe.groupBy("structure_id").agg(F.count_distinct("world_family").alias("n")).filter("n > 1").select(
        F.col("structure_id").alias("key"), F.lit("two families").alias("problem"))
    seen = rows.select("run_id", "structure_id", "world_family").distinct()
    u = universe.select("run_id", F.col("structure_id").alias("us"), F.col("world_family").alias("uf"))
    differ = seen.join(u, "run_id", "left").filter(
        ~F.col("structure_id").eqNullSafe(F.col("us")) | ~F.col("world_family").eqNullSafe(F.col("uf"))).select(
        F.col("run_id").alias("key"), F.lit("row disagrees").alias("problem"))
    return repeated.unionByName(families).unionByName(differ)


def denominator_gaps(rows: DataFrame, universe: DataFrame) -> DataFrame:
    """Rows without a run, with a non-finite return, or of a run missing from the universe."""
    odd = rows.filter(F.col("run_id").isNull() | _bad(_finite("net_directional_return")))
    return odd.unionByName(rows.filter(F.col("run_id").isNotNull()).join(universe.select("run_id"), "run_id", "left_anti").select(*rows.columns))


def repeated_units(metrics: DataFrame) -> DataFrame:
    """Hypothesis groups where a run or seed counts twice."""
    g = metrics.groupBy("structure_id", "hypothesis", "horizon").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("run_id").alias("runs"), F.count_distinct("seed").alias("seeds"))
    return g.filter((F.col("rows") != F.col("runs")) | (F.col("rows") != F.col("seeds")))


def bad_trade_rows(rows: DataFrame) -> DataFrame:
    """Intervals must satisfy 0 <= entry <= exit and scores lie in [0, 1]."""
    ok = (F.col("entry_index") >= 0) & (F.col("exit_index") >= F.col("entry_index")) & _finite("probability") & F.col("probability").between(0.0, 1.0)
    return rows.filter(_bad(ok))


def bad_labels_binary(rows: DataFrame, label: str = "label") -> DataFrame:
    """Labels other than 0 and 1."""
    return rows.filter(_bad(F.col(label).isin(0, 1)))


def check_features(features: Sequence[str], columns: Sequence[str], outcomes: Sequence[str]) -> list[str]:
    """Problems of a feature list: leaked outcomes, repeats, missing columns."""
    out = [f"outcome used as input: {f}" for f in features if f in set(outcomes)]
    out += [f"repeated: {f}" for f in sorted({f for f in features if list(features).count(f) > 1})]
    return out + [f"missing: {f}" for f in features if f not in set(columns)]


def split_leaks(splits: DataFrame) -> DataFrame:
    """Structures that appear in more than one split."""
    return splits.groupBy("structure_id").agg(F.count_distinct("split").alias("splits")).filter("splits > 1")


def one_class_splits(rows: DataFrame, label: str = "profitable") -> DataFrame:
    """Splits with a single label class."""
    return rows.groupBy("split").agg(F.count_distinct(label).alias("classes"), F.count(F.lit(1)).alias("rows")).filter("classes < 2")


def label_mismatch(rows: DataFrame) -> DataFrame:
    """The label must say whether the net return is positive."""
    ok = _finite("net_directional_return") & (F.col("profitable") == (F.col("net_directional_return") > 0).cast("int"))
    return rows.filter(_bad(ok))


def catalog_problems(structures: DataFrame, runs: DataFrame, rows: DataFrame) -> DataFrame:
    """Index gaps, runs without structure, and row counts that do not add up."""
    s = structures.agg(F.min("structure_index").alias("lo"), F.max("structure_index").alias("hi"), F.count(F.lit(1)).alias("n")).filter(
        _bad((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1))).select(F.lit("index gap").alias("problem"), F.col("n").cast("string").alias("key"))
    orphan = runs.join(structures, "structure_id", "left_anti").select(F.lit("run without structure").alias("problem"), F.col("run_id").alias("key"))
    counted = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("found"))
    off = runs.join(counted, "run_id", "left").filter(F.coalesce("found", F.lit(0)) != F.col("row_count")).select(
        F.lit("row count").alias("problem"), F.col("run_id").alias("key"))
    return s.unionByName(orphan).unionByName(off)


def changed_files(spark, catalog: DataFrame, folder: str) -> DataFrame:
    """Files whose bytes or hash differ from the catalog, or that are missing."""
    from candlemill.sinks.files import artifact_table

    f = artifact_table(spark, folder).withColumnsRenamed({"bytes": "now_bytes", "sha256": "now_sha256"})
    return catalog.join(f, "file_name", "left").filter(
        ~F.col("now_bytes").eqNullSafe(F.col("bytes")) | ~F.col("now_sha256").eqNullSafe(F.col("sha256")))


def cost_identity_breaks(trades: DataFrame) -> DataFrame:
    """Gross - cost must equal net."""
    gap = F.abs(F.col("gross_return") - F.col("total_transaction_cost") - F.col("net_return"))
    return trades.filter(_bad(gap <= F.greatest(F.abs("net_return"), F.abs("gross_return")) * 1e-12 + 1e-15))


def out_of_order_runs(runs: DataFrame, order: str, structure_index: str) -> DataFrame:
    """Runs whose structure index falls back along the processing order (optional check)."""
    x = over_halo(runs.withColumn("_all", F.lit("all")), 1, lambda w: {"_prev": F.lag(structure_index).over(w)}, run=["_all"], index=order)
    return x.filter(F.col("_prev").isNotNull() & (F.col(structure_index) < F.col("_prev"))).drop("_all")


def contract_differences(manifest: DataFrame, expected: dict) -> DataFrame:
    """Keys of a frozen one-row manifest that differ from the expected contract."""
    item = lambda k, v: F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("frozen"), F.lit(str(v)).alias("expected"))
    x = manifest.select(F.explode(F.array(*[item(k, v) for k, v in sorted(expected.items())])).alias("d")).select("d.*")
    return x.filter(~F.col("frozen").eqNullSafe(F.col("expected")))
