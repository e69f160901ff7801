"""Checks of the walk table where its rounded price has fallen to zero."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlemill.catalog.load import queries
from candlemill.session import scratch_path


def test_checks_tell_planted_prices_from_rounded_ones(spark):
    path = scratch_path(spark, "falling-events")
    # every event moves the walk by 50 down: from the 2,607th on it rounds to zero
    spark.range(3000).select(
        F.col("id").alias("event_id"), F.lit("view").alias("event_type"), F.timestamp_seconds(F.col("id") + 1_577_836_800).alias("ts"),
        (F.col("id") % 50).alias("user_id"), F.lit(7.0).alias("value")).write.parquet(f"{path}/events.parquet")
    bad = {r.bar_index for r in queries()["V3_candle_sequence"](spark, path).collect()}
    assert bad == {i for i in range(600) if i % 11 == 10 or i % 29 == 3}
    opens = {r.step: r.open for r in queries()["CAN4_tick_derived_columns"](spark, path).collect()}
    assert all((opens[i] == 8.0) == (i % 9 == 0) for i in range(3000)) and opens[2999] == 0.0 and opens[1] > 90
