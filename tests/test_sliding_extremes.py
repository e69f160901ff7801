"""Sliding extremes from lags against plain frames, and what a signal costs."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from candlemill.functions.windows import over_halo, sliding_extremes
from candlemill.operators.signals import signal_events


def test_sliding_extremes_equal_frames(spark):
    x = F.when(F.col("id") % 7 == 3, F.lit(None)).when(F.col("id") % 41 == 5, float("nan")).otherwise(F.abs(F.hash("id")) % 1000 / 7.0)
    bars = spark.range(700).select(F.lit("r").alias("run_id"), F.col("id").alias("bar_index"), x.alias("close"))
    for length, end in ((1, 0), (5, 1), (6, 0), (25, 2), (26, 1), (120, 1)):

        def build(w):
            f = w.rowsBetween(1 - length - end, -end)
            return [{"max0": F.max("close").over(f), "min0": F.min("close").over(f)},
                    *sliding_extremes(w, length, end, {"max1": ("max", "close"), "min1": ("min", "close")})]

        out = over_halo(bars, length + end, build, chunk=150)
        assert out.count() == 700
        assert out.filter("NOT (max0 <=> max1) OR NOT (min0 <=> min1)").count() == 0


def test_signal_channel_is_no_long_frame(spark):
    """Before, every bar compared the 120 bars of its channel one by one."""
    bars = spark.range(500).select(F.lit("r").alias("run_id"), F.col("id").alias("bar_index"), (F.abs(F.hash("id")) % 1000 / 7.0).alias("close"))
    text = io.StringIO()
    with redirect_stdout(text):
        signal_events(bars).explain()
    assert "-120" not in text.getvalue() and "-23" in text.getvalue()
