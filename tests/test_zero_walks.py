"""Series whose prices fall to zero: quotes, signals and fingerprints do not stop, and have what floating point has."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from candlemill.catalog.pattern_rows import geometry_prefix
from candlemill.operators import bars as B, signals as G


def falling(spark, zeros: int = 40):
    """30 positive closes, then zeros."""
    closes = [100.0 - i for i in range(30)] + [0.0] * zeros
    rows = [("a", i, c) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "run_id string, bar_index long, close double")


def test_quotes_over_a_mid_of_zero(spark):
    quote = "bid double, ask double, post_bid double, post_ask double, post_reference double, reference double"
    rows = [("a", 0, 1, 0.0, 9.0, 9.0, 11.0, 9.0, 11.0, 10.0, 10.0), ("a", 1, 1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), ("a", 2, 1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0)]
    ticks = spark.createDataFrame([r[:4] + r[5:] for r in rows], "run_id string, step long, volume long, price double, " + quote)
    bars = B.with_execution_columns(B.build_bars(ticks, 1, extra=B.execution_quotes()))
    got = {r.bar_index: r for r in bars.collect()}
    assert got[0].entry_spread == 0.2 and got[0].exit_spread == 0.2
    assert math.isnan(got[1].entry_spread) and math.isnan(got[1].exit_spread) and got[1].entry_mid == 0.0
    assert got[2].exit_spread == math.inf and got[2].entry_spread == 2.0


def test_signals_over_zero_prices(spark):
    x = falling(spark)
    got = {r.bar_index: r.trailing_return for r in G.momentum_signal(x).collect()}
    assert got[29] == math.log(71.0 / 83.0) and got[30] == -math.inf and math.isnan(got[60])
    free = {r.bar_index: r for r in G.rule_signals(x, floor=None).collect()}
    kept = {r.bar_index: r for r in G.rule_signals(x).collect()}
    assert free[30].breakout_signal == -1.0 and free[69].breakout_signal == 0.15  # no channel: not a number, cut as the SQL cuts it
    assert free[69].ma_signal == 1.0 and kept[69].ma_signal == 0.0
    assert all(abs(free[i].rule_signal - kept[i].rule_signal) < 1e-12 for i in range(30)) and all(r.contrarian_signal is not None for r in free.values())


def test_fingerprints_tell_infinite_logarithms_apart(spark):
    zero = falling(spark, 3)
    lone = zero.withColumn("close", F.when(F.col("bar_index") == 31, 5.0).otherwise(F.col("close")))
    a, b = ({r.bar_index: r.geometry_prefix for r in geometry_prefix(spark, "", lambda s, d: x).collect()} for x in (zero, lone))
    assert len(set(a.values())) == 33 and all((a[i] == b[i]) == (i < 31) for i in range(33))
