"""Chunked and bucketed forms equal their plain one-pass definitions."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from candlemill.config import ExperimentConfig, PatternConfig
from candlemill.functions.student_t import t_quantile, t_tail
from candlemill.functions.windows import bucketed_rank, bucketed_scan, over_halo
from candlemill.operators import controls as N, overlap as O, recursions as R, trades as X
from candlemill.operators.dataset import split_counts
from candlemill.sources.series import number_series


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(5)
    rows = [(r, i, rng.randint(-9, 9)) for r in ("a", "b") for i in range(203)]
    return spark.createDataFrame(rows, "run_id string, bar_index long, v long")


def test_halo_chunks_equal_whole_window(series):
    build = lambda w: {"s": F.sum("v").over(w.rowsBetween(-6, 2)), "p": F.lag("v").over(w)}
    got = over_halo(series, 6, build, ahead=2, chunk=16)
    w = Window.partitionBy("run_id").orderBy("bar_index")
    want = series.withColumns(build(w))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.mark.parametrize("reverse", [False, True])
def test_bucketed_scan_equals_running_aggregate(series, reverse):
    x = series.withColumn("b", F.floor(F.col("bar_index") / 10))
    order = [F.col("bar_index").desc() if reverse else F.col("bar_index")]
    scans = {"c": ("sum", "v"), "hi": ("max", "v"), "lo": ("min", "v")}
    got = bucketed_scan(x, ["run_id"], "b", order, scans, reverse=reverse).select("run_id", "bar_index", "c", "hi", "lo")
    w = Window.partitionBy("run_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    want = series.select("run_id", "bar_index", F.sum("v").over(w).alias("c"), F.max("v").over(w).alias("hi"), F.min("v").over(w).alias("lo"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_bucketed_rank_is_a_row_number(series):
    x = series.withColumn("b", F.floor((F.col("v") + 9) / 4))
    got = {(r.run_id, r.bar_index): r["rank"] for r in bucketed_rank(x, ["run_id"], "b", ["v", "bar_index"]).collect()}
    for run in "ab":
        rows = sorted((r.v, r.bar_index) for r in series.filter(F.col("run_id") == run).collect())
        assert [got[(run, i)] for _, i in rows] == list(range(1, len(rows) + 1))


def test_number_series_is_dense_and_ordered(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.8 else "cold", rng.randint(0, 50), i, rng.randint(-5, 5)) for i in range(1000)]
    df = spark.createDataFrame(rows, "run_id string, t long, id long, m long")
    out = number_series(df, "run_id", ["t", "id"], running={"total": "m"}).toPandas().sort_values(["run_id", "t", "id"])
    for _, g in out.groupby("run_id"):
        assert g["step"].tolist() == list(range(len(g)))
        assert g["total"].tolist() == g["m"].cumsum().tolist()


def _naive_skip(rows):
    open_until, out = -1, []
    for entry, exit_ in sorted(rows):
        if entry > open_until:
            out.append(entry)
            open_until = exit_
    return out


@pytest.mark.parametrize("density", [0.05, 0.4, 1.0])
def test_skip_new_equals_sequential_rule(spark, density):
    rng = random.Random(int(density * 100))
    rows = [(k, i, i + rng.randint(0, 7)) for k in ("x", "y", "z") for i in range(400) if rng.random() < density]
    df = spark.createDataFrame(rows, "k string, entry_index long, exit_index long")
    got = O.skip_new(df, ["k"], 7, chunk=8).filter("accepted").toPandas()
    for k in ("x", "y", "z"):
        assert sorted(got[got.k == k].entry_index) == _naive_skip([(e, x) for kk, e, x in rows if kk == k])


def test_skip_new_reads_the_longest_hold_from_the_trades(spark):
    rng = random.Random(4)
    rows = [("x", i, i + rng.choice([0, 2, 40])) for i in range(400)] + [("y", 0, 5000), ("y", 3, 4), ("y", 5001, 5001), ("y", 90_000, 90_000)]
    df = spark.createDataFrame(rows, "k string, entry_index long, exit_index long")
    got = O.skip_new(df, ["k"], 3, chunk=32).filter("accepted").toPandas()
    for k in ("x", "y"):
        assert sorted(got[got.k == k].entry_index) == _naive_skip([(e, x) for kk, e, x in rows if kk == k])


def test_skip_new_with_a_signal_on_every_bar_of_a_long_run(spark):
    df = spark.range(300_000).select(F.lit("x").alias("k"), F.col("id").alias("entry_index"), (F.col("id") + 2).alias("exit_index"))
    got = O.skip_new(df, ["k"], chunk=256).filter("accepted").agg(F.count(F.lit(1)), F.max(F.col("entry_index") % 3)).head()
    assert tuple(got) == (100_000, 0)


@pytest.mark.parametrize("levels", [1, 3, None])
def test_nearest_pool_equals_brute_force(spark, levels):
    rng = random.Random(levels or 9)
    spread = lambda: 0.001 * (1 + rng.randrange(levels)) if levels else 0.001 * math.exp(rng.uniform(-2, 2))
    pool = [("r", 5, 43, i, rng.choice([0.0, 0.01, round(rng.uniform(0.005, 0.03), 4)]), spread()) for i in range(43, 343)]
    targets = [("r", 5, 43, 1000 + i, rng.choice([0.0, rng.uniform(0.004, 0.03)]), spread()) for i in range(40)]
    p = spark.createDataFrame(pool, "run_id string, horizon int, min_entry long, entry_index long, trailing_vol double, entry_spread double")
    t = spark.createDataFrame(targets, "run_id string, horizon int, min_entry long, target long, trailing_vol double, entry_spread double")
    got = N.nearest_pool(p, t, 7).toPandas()
    eps = 1e-12
    for _, _, _, target, vol, spr in targets:
        d = sorted((abs(math.log(v + eps) - math.log(vol + eps)) + abs(0.25 * math.log(s + eps) - 0.25 * math.log(spr + eps)), i) for _, _, _, i, v, s in pool)
        mine = got[got.target == target].sort_values("pool_rank")
        assert np.allclose(mine.distance, [x[0] for x in d[:7]], atol=1e-12)
        cut = d[6][0]
        clear = {i for dist, i in d if dist < cut - 1e-9}
        assert clear <= set(mine.entry_index)


def test_control_exclusion_boundaries(spark):
    e = spark.createDataFrame([("r", 50), ("r", 130)], "run_id string, entry_index long")
    banned = {r.entry_index for r in N.forbidden_entries(e, [20], 5).collect()}
    assert 25 not in banned and 26 in banned and 74 in banned and 75 not in banned
    assert 105 not in banned and 106 in banned and 154 in banned and 155 not in banned


def test_decayed_state_equals_plain_recursion(spark):
    rng = random.Random(3)
    rows = [("r", i, rng.random()) for i in range(9000)]
    df = spark.createDataFrame(rows, "run_id string, bar_index long, x double")
    got = R.decayed_states(df, {"s": "x"}, 0.9, ceiling=6.0).toPandas().sort_values("bar_index")
    s, want = 0.0, []
    for _, _, x in rows:
        s = min(0.9 * s + x, 6.0)
        want.append(s)
    assert np.allclose(got.s, want, atol=1e-12)


def test_round_trip_costs_closed_form(spark):
    df = spark.createDataFrame([(100.0, 110.0, 1, 0.02, 0.04), (100.0, 110.0, -1, 0.02, 0.04), (100.0, 100.0, 1, 0.0, 0.0)],
                               "em double, xm double, d int, es double, xs double")
    rows = df.select("*", *[v.alias(k) for k, v in X.round_trip(F.col("em"), F.col("xm"), F.col("d"), F.col("es"), F.col("xs")).items()]).collect()
    long_, short, flat = rows
    assert long_.gross_return == pytest.approx(0.10)
    assert long_.net_return == pytest.approx((110 * 0.98 - 100 * 1.01) / 100 - 1e-4 * (101 + 107.8) / 100)
    assert short.net_return == pytest.approx((100 * 0.99 - 110 * 1.02) / 100 - 1e-4 * (99 + 112.2) / 100)
    assert flat.net_return == pytest.approx(-2e-4)
    for r in rows:
        assert r.gross_return - r.total_transaction_cost == pytest.approx(r.net_return, abs=1e-15)


def test_student_t_published_values():
    # Published two-sided 95% critical values.
    for df, value in ((1, 12.7062), (2, 4.30265), (5, 2.57058), (10, 2.22814), (30, 2.04227), (120, 1.97993)):
        assert t_quantile(0.975, df) == pytest.approx(value, abs=1e-4)
    assert t_tail(0.0, 7) == pytest.approx(0.5)
    assert t_tail(2.22814, 10) == pytest.approx(0.025, abs=1e-6)
    assert t_tail(-1.0, 4) + t_tail(1.0, 4) == pytest.approx(1.0)


def test_split_counts():
    assert split_counts(10) == {"train": 6, "validation": 2, "test": 2}
    assert split_counts(3) == {"train": 1, "validation": 1, "test": 1}
    for n in range(3, 60):
        c = split_counts(n)
        assert sum(c.values()) == n and min(c.values()) >= 1


def test_scale_lengths_and_thresholds():
    c = PatternConfig()
    assert [c.observation_length(k) for k in c.core_lengths] == [43, 67, 96]
    assert [c.max_age(k) for k in c.core_lengths] == [5, 8, 12]
    t = ExperimentConfig().thresholds()
    assert len(t) == 17 and t[0] == 0.5 and t[-1] <= 0.9
    with pytest.raises(ValueError):
        PatternConfig(bandwidth_multipliers=(0.9, 1.1))
