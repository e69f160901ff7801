"""Numbering sends its offsets to the rows, and sorts only where there are too many."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from candlemill.operators import dataset as D
from candlemill.sources import series


def _plan(df) -> str:
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain()
    return text.getvalue()


@pytest.mark.parametrize("most", [0, 1000])
def test_numbers_do_not_depend_on_how_offsets_are_joined(spark, monkeypatch, most):
    monkeypatch.setattr(series, "OFFSET_ROWS", most, raising=False)
    df = spark.range(2000).select(F.concat(F.lit("r"), (F.col("id") % 7).cast("string")).alias("run_id"), F.hash("id").alias("t"), F.lit(1).alias("one"))
    out = series.number_series(df, "run_id", ["t"])
    assert "Exchange hashpartitioning" not in _plan(out) if most else "SortMergeJoin" in _plan(out)  # before: always exchanged
    g = out.groupBy("run_id").agg(F.count("*").alias("n"), F.max("step").alias("top"), F.count_distinct("step").alias("d")).collect()
    assert len(g) == 7 and all(r.n == r.d == r.top + 1 for r in g)


def test_labels_are_joined_by_sorting(spark):
    bars = spark.range(60).select(F.lit("r").alias("run_id"), F.col("id").alias("bar_index"), *[F.lit(1.0).alias(c) for c in (
        "open", "high", "low", "close", "entry_mid", "exit_mid")], *[F.lit(0.001).alias(c) for c in ("entry_spread", "exit_spread")])
    events = bars.select("run_id", F.lit(True).alias("breakout_confirmed"), F.lit("bullish").alias("breakout_direction"), F.lit("x").alias("pattern_name"),
                         F.col("bar_index").alias("available_at_index"), (F.col("bar_index") + 1).alias("entry_index"))
    out = D.label_rows(events, bars, [bars.select("run_id", "bar_index", F.col("close").alias("f"))], 20)
    assert "Broadcast" not in _plan(out)  # before: events were broadcast
    assert out.count() == 40
