"""Prices that reach zero: floating-point results where the SQL has them, never an error or a silent NULL."""

import math

from pyspark.sql import functions as F

from candlemill.functions.columns import divide, ln
from candlemill.operators import features as T, signals as G, trades as X
from candlemill.functions.windows import over_halo
from candlemill.patterns.detect import context_features


def bars(spark):
    close = [2.0, 1.0, 0.0, 0.0, 1e-9]
    rows = [("a", i, c, c, c, c, 1) for i, c in enumerate(close)]
    return spark.createDataFrame(rows, "run_id string, bar_index long, open double, high double, low double, close double, volume long")


def same(a, b):
    return (a is None) == (b is None) and (a is None or a == b or (math.isnan(a) and math.isnan(b)))


def test_logarithm_and_quotient_of_zero(spark):
    r = spark.range(1).select(ln(F.lit(0.0)), ln(F.lit(1.0)), divide(F.lit(1.0), F.lit(0.0)), divide(F.lit(-2.0), F.lit(0.0)), divide(F.lit(0.0), F.lit(0.0)),
                              divide(F.lit(3.0), F.lit(2.0)), divide(F.lit(None).cast("double"), F.lit(0.0))).head()
    assert all(same(x, y) for x, y in zip(r, [-math.inf, 0.0, math.inf, -math.inf, math.nan, 1.5, None]))


def test_returns_over_a_zero_price(spark):
    rel = [r[0] for r in T.relative_log_price(bars(spark)).orderBy("bar_index").select("rel_log").collect()]
    assert rel[2] == rel[3] == -math.inf and rel[1] == math.log(1.0) - math.log(2.0)
    bare = [r[0] for r in over_halo(bars(spark), 1, lambda w: {"ret": T.log_return(w, floor=None)}).orderBy("bar_index").select("ret").collect()]
    assert bare[0] is None and bare[2] == -math.inf and math.isnan(bare[3]) and bare[4] == math.inf
    kept = [r[0] for r in T.lag_pairs(bars(spark)).orderBy("bar_index").select("ret").collect()]
    assert kept[2:] == [None, None, None]  # by default only returns between positive prices
    guarded = T.bar_features(bars(spark)).orderBy("bar_index").select("recent_range_pct_20").collect()
    assert all(math.isfinite(r[0]) for r in guarded)
    open_ = T.bar_features(bars(spark), floor=None).orderBy("bar_index").select("recent_range_pct_20").collect()
    assert open_[2][0] == math.inf


def test_a_rise_from_zero_has_a_direction(spark):
    def build(w):
        mode, signal = G.round_level_signal(w)
        return {"mode": mode, "signal": signal}

    last = over_halo(bars(spark), 1, build).filter("bar_index = 4").select("mode", "signal").head()
    assert tuple(last) == ("round_resistance", -0.45)


def test_outcomes_and_context_over_a_zero_price(spark):
    """A bar at zero neither stops the job nor touches the rows of other bars."""
    x = bars(spark).withColumns({"entry_mid": F.col("close"), "exit_mid": F.col("close"), "entry_spread": F.lit(0.0), "exit_spread": F.lit(0.0)})
    got = {r["entry_index"]: r for r in X.horizon_outcomes(x, [2]).filter("direction = 1").collect()}
    assert got[0]["gross_return"] == -0.5 and got[1]["gross_return"] == -1.0
    assert math.isnan(got[2]["gross_return"]) and got[3]["gross_return"] == math.inf
    moves = X.excursion_columns(F.lit(1), F.col("entry_mid"), F.col("high"), F.col("low"))
    far = [r[0] for r in x.orderBy("bar_index").select(moves["maximum_favorable_excursion"]).collect()]
    assert far[:2] == [0.0, 0.0] and math.isnan(far[2])
    found = spark.createDataFrame([("a", "c", 1, 3), ("a", "d", 1, 1)], "run_id string, candidate_id string, start_index long, end_index long")
    range_ = {r["candidate_id"]: r["pattern_mean_log_high_low_range"] for r in context_features(found, bars(spark)).collect()}
    assert math.isnan(range_["c"]) and range_["d"] == 0.0
