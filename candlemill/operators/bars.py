"""Candles from ticks, and the executable quotes a trade on them would meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from candlemill.functions.columns import divide


def tick_derived_columns(ticks: DataFrame) -> DataFrame:
    """Spread columns and the OHLC fallback to the trade price where a field is not positive."""
    spread = F.col("ask") - F.col("bid")
    post = F.col("post_ask") - F.col("post_bid")
    out = ticks.withColumns({
        "spread": spread,
        "post_spread": F.when((F.col("post_bid") > 0) & (F.col("post_ask") > 0), post).otherwise(spread),
    })
    for name in ("open", "high", "low", "close"):
        if name in ticks.columns:
            out = out.withColumn(name, F.when(F.col(name) > 0, F.col(name)).otherwise(F.col("price")))
    return out


def build_bars(
    ticks: DataFrame,
    ticks_per_bar: int,
    *,
    price: str = "price",
    include_partial: bool = False,
    extra: list[Column] | None = None,
) -> DataFrame:
    """Fixed-count OHLCV bars; the partial tail is dropped unless asked for.

    ``step`` is dense per run, so a bar is plain arithmetic and one hash aggregate with map-side
    combine. The keys are fine-grained: a hot run spreads over all tasks.
    """
    bars = (
        ticks.withColumn("bar_index", F.floor(F.col("step") / ticks_per_bar).cast("long"))
        .groupBy("run_id", "bar_index")
        .agg(
            F.min("step").alias("start_step"),
            F.max("step").alias("end_step"),
            F.min_by(price, "step").alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, "step").alias("close"),
            F.sum("volume").alias("volume"),
            F.count(F.lit(1)).alias("tick_count"),
            *(extra or []),
        )
        .withColumn("is_complete", F.col("tick_count") == ticks_per_bar)
        .withColumn("candle_number", F.col("bar_index") + 1)
    )
    return bars if include_partial else bars.filter("is_complete")


def execution_quotes() -> list[Column]:
    """Aggregates for :func:`build_bars`: first opening quote and last closing quote of a bar."""
    return [
        F.min_by("bid", "step").alias("_bid0"),
        F.min_by("ask", "step").alias("_ask0"),
        F.max_by(F.struct("post_bid", "post_ask", "post_reference", "reference", "bid", "ask"), "step").alias("_q1"),
    ]


def with_execution_columns(bars: DataFrame) -> DataFrame:
    """entry/exit mid and full-spread fraction; no join back to the ticks is needed.

    The closing quote is the post-trade one. Where both its sides are zero (old rows), the
    post-trade reference price and the opening spread over the reference stand in. Over a mid or reference of zero a spread is
    infinite or not a number.
    """
    q = F.col("_q1")
    pb, pa = q["post_bid"], q["post_ask"]
    good = (pb > 0) & (pa >= pb)
    mid0 = 0.5 * F.col("_bid0") + 0.5 * F.col("_ask0")
    mid1 = F.when(good, 0.5 * pb + 0.5 * pa).otherwise(q["post_reference"])
    spread1 = F.when(good, (pa - pb) / (0.5 * pb + 0.5 * pa)).otherwise(
        F.greatest(F.lit(0.0), divide(q["ask"] - q["bid"], q["reference"]))
    )
    return bars.withColumns({
        "entry_mid": mid0,
        "exit_mid": mid1,
        "entry_spread": divide(F.col("_ask0") - F.col("_bid0"), mid0),
        "exit_spread": F.greatest(F.lit(0.0), spread1),
    }).drop("_bid0", "_ask0", "_q1")


def bad_quotes(ticks: DataFrame) -> DataFrame:
    """Ticks whose quotes cannot be traded: crossed, non-positive or half-missing."""
    opening = (F.col("bid") > 0) & (F.col("ask") >= F.col("bid"))
    closing = (F.col("post_bid") > 0) & (F.col("post_ask") >= F.col("post_bid"))
    absent = (F.col("post_bid") == 0) & (F.col("post_ask") == 0)
    return ticks.filter(~F.coalesce(opening & (closing | absent), F.lit(False)))


def bar_dataset_id(config: dict, ticks_per_bar: int, include_partial: bool = False) -> Column:
    """Identity of a bar table: hash of the settings that produced it."""
    parts = [F.lit(config[k]).alias(k) for k in sorted(config)]
    payload = F.struct(
        F.lit(bool(include_partial)).alias("include_partial"), *parts,
        F.lit(int(ticks_per_bar)).alias("ticks_per_bar"),
    )
    return F.concat(F.lit("BARS-"), F.substring(F.sha2(F.to_json(payload), 256), 1, 20))
