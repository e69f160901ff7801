"""What is looked up by bar gives the same rows as the tables of all bars, horizons and prefixes, without building them."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlemill.config import CostModel
from candlemill.operators import controls as N, trades as X
from candlemill.sources.series import number_series


def bars(spark, n: int = 90):
    """Two runs of unlike length, over several chunks of the scans below."""
    x = spark.range(n).select(F.col("id").alias("bar_index"), (100 + F.sin(F.col("id") * 1.7) * 5).alias("close"), (0.001 * (1 + F.col("id") % 3)).alias("entry_spread"))
    x = x.withColumns({"open": F.col("close"), "high": F.col("close") + 1, "low": F.col("close") - 1, "volume": F.col("bar_index") % 7,
                       "entry_mid": F.col("close"), "exit_mid": F.col("close") * 1.001, "exit_spread": F.col("entry_spread")})
    return x.withColumn("run_id", F.lit("a")).unionByName(x.filter("bar_index < 40").withColumn("run_id", F.lit("b")))


def test_outcomes_looked_up_by_entry(spark):
    x, costs = bars(spark), CostModel()
    asked = [(r, i, h, d) for r in "abc" for i in (0, 3, 35, 36, 39, 80, 85, 89, 200) for h in (1, 5, 10) for d in (-1, 1)]
    asked = spark.createDataFrame(asked, "run_id string, entry_index long, horizon int, direction int")
    met = X.looked_up(asked, X.horizon_exits(x, (5, 1, 10)), (1, 5, 10))
    got = met.withColumns(X.round_trip(F.col("entry_mid"), F.col("exit_mid"), F.col("direction"), F.col("entry_spread"), F.col("exit_spread"), costs))
    keys = ["run_id", "entry_index", "horizon", "direction"]
    want = asked.join(X.horizon_outcomes(x, (1, 5, 10), costs), keys)
    cols = [*keys, "exit_mid", "exit_spread", "gross_return", "net_return", "total_transaction_cost"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect())) and want.count() > 40


def test_prefixes_of_wanted_bars_only(spark):
    x = bars(spark)
    at = spark.createDataFrame([("a", 0), ("a", 17), ("a", 89), ("a", 90), ("b", 39), ("b", 40), ("c", 1)], "run_id string, bar_index long")
    text = N.bar_text(["open", "close"])
    every = {(r.run_id, r.bar_index): r.f for r in N.running_fingerprint(x, text, "f", chunk=8).collect()}
    some = {(r.run_id, r.bar_index): r.f for r in N.running_fingerprint(x, text, "f", chunk=8, at=at).collect()}
    assert some == {k: every[k] for k in [("a", 0), ("a", 17), ("a", 89), ("b", 39)]}  # a mark without a bar has no prefix


def test_a_pool_reads_the_end_of_a_run_from_its_states(spark):
    x = bars(spark).withColumn("trailing_vol", F.col("close") / 1000)
    counts = x.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_bars"))
    signals = spark.createDataFrame([("a", 20), ("a", 21), ("a", 90), ("b", 5)], "run_id string, entry_index long")
    one, two = (N.control_pool(x, n, signals, [1, 5, 20], [1, 8], 3) for n in (counts, None))
    cols = ["run_id", "horizon", "min_entry", "entry_index", "trailing_vol", "entry_spread"]
    assert set(one.columns) == set(two.columns) and sorted(map(tuple, one.select(cols).collect())) == sorted(map(tuple, two.select(cols).collect()))


def test_controls_share_the_means_of_their_set(spark):
    x = bars(spark)
    drawn = spark.createDataFrame([("a", 5, 1, 30, "p", i) for i in (2, 7, 50)] + [("a", 5, 1, 31, "p", 3)], "run_id string, horizon int, min_entry long, target long, pattern_name string, entry_index long")
    trades = spark.createDataFrame([("a", 5, 1, "p", "e1", h, 1, 30) for h in ("p", "all")] + [("a", 5, 1, "p", "e2", "p", -1, 31), ("a", 5, 1, "p", "e3", "p", 1, 33)],
                                   "run_id string, horizon int, min_entry long, pattern_name string, event_id string, hypothesis string, direction int, entry_index long")
    got = {(r.hypothesis, r.event_id): r for r in N.control_returns(drawn, trades, X.horizon_exits(x, [5]), 2, [5]).collect()}
    out = {(r.entry_index, r.direction): r for r in X.horizon_outcomes(x, [5]).filter("run_id = 'a'").collect()}
    mean = sum(out[i, 1].net_return for i in (2, 7, 50)) / 3
    assert set(got) == {("p", "e1"), ("all", "e1"), ("p", "e2")}
    assert all(abs(got[h, "e1"].matched_null_mean_net_return - mean) < 1e-12 and got[h, "e1"].matched_null_count == 3 for h in ("p", "all"))
    assert got["p", "e2"].matched_null_count == 1 and got["p", "e2"].matched_null_mean_net_return is None


def test_numbering_writes_wanted_columns_only(spark):
    x = spark.createDataFrame([("a", 3, 1.0, "x"), ("a", 1, 2.0, "y"), ("b", 2, 3.0, "z")], "run_id string, at long, value double, more string")
    got = number_series(x, "run_id", ["at"], keep=["run_id", "value"], running={"total": "value"})
    assert sorted(map(tuple, got.collect())) == [("a", 1.0, 1, 3.0), ("a", 2.0, 0, 2.0), ("b", 3.0, 0, 3.0)] and got.columns == ["run_id", "value", "step", "total"]
