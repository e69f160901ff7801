"""Exact quantiles, ordered ranges and the box-tree neighbour search against plain definitions, on hot and lopsided data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlemill.functions.windows import bucketed_scan
from candlemill.operators import inference as I, quantiles
from candlemill.operators.classification import ranking_metrics, score_curve
from candlemill.operators.neighbours import nearest_points
from candlemill.operators.quantiles import exact_medians, exact_quantiles
from candlemill.sources.series import ordered

CUTS = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]


def test_quantiles_of_one_key_with_a_million_rows(spark):
    df = spark.range(1_000_000).select(F.lit("hot").alias("k"), (F.exp(F.randn(3) * 8) * F.when(F.rand(5) < 0.3, -1).otherwise(1)).alias("v"))
    df = df.unionByName(spark.range(5).select(F.lit("cold").alias("k"), F.col("id").cast("double").alias("v")))
    got = {r.k: r.quantiles for r in exact_quantiles(df, ["k"], "v", CUTS).collect()}
    values = np.array([r.v for r in df.filter("k = 'hot'").toPandas().itertuples()])
    np.testing.assert_allclose(got["hot"], np.quantile(values, CUTS), rtol=1e-12)
    np.testing.assert_allclose(got["cold"], np.quantile(np.arange(5.0), CUTS))
    plan = exact_quantiles(df, ["k"], "v", [0.5])._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "percentile" not in plan and "median" not in plan


@pytest.mark.parametrize("values", [
    [1.0], [0.0, -0.0, 0.0], [-1e-300, 1e-300, 0.0], [1.0, 1.0 + 2**-52, 1.0 + 2**-51, 1.0], [1e200, -1e200, 3.0, 3.0], list(np.repeat([7.0, 8.0], [900, 3])),
    list(np.random.default_rng(2).normal(0, 1e-9, 500)), list(np.arange(100) / 7.0),
])
def test_quantiles_of_lopsided_values(spark, values, monkeypatch):
    monkeypatch.setattr(quantiles, "BROADCAST_ROWS", 1)
    df = spark.createDataFrame([(None, float(v)) for v in values] + [(None, None), (None, float("nan")), (3, None)], "k int, v double")
    got = exact_quantiles(df, ["k"], "v", CUTS).collect()
    assert [r.k for r in got] == [None]
    np.testing.assert_allclose(got[0].quantiles, np.quantile(np.array(values), CUTS), rtol=1e-13, atol=1e-300)


def test_quantiles_without_keys_or_rows(spark):
    df = spark.range(11).select(F.col("id").cast("double").alias("v"))
    assert exact_quantiles(df, [], "v", [0.5]).collect()[0].quantiles == [5.0]
    assert exact_quantiles(df.filter("false"), [], "v", [0.5]).collect() == []
    assert exact_medians(df.filter("false"), ["v"], "v", "m").collect() == []


def test_ordered_ranges_hold_equal_shares(spark):
    """Scores all next to zero, and many equal ones told apart by their key, spread over all parts."""
    df = spark.range(80_000).select("id", F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.rand(1) * 1e-6).alias("p")).repartition(16)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = ordered(df, ["p", "id"]).groupBy("_pid").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(parts) == 8 and max(r["count"] for r in parts) < 2 * 80_000 / 8
    scan = bucketed_scan(ordered(df, ["p", "id"]).withColumn("one", F.lit(1)), [], "_pid", ["_pos"], {"rank": ("sum", "one")})
    got = [r.id for r in scan.orderBy("rank").select("id").collect()]
    assert got == [r.id for r in df.orderBy("p", "id").collect()]


def test_ranking_of_scores_of_a_rare_event(spark):
    rng = np.random.default_rng(4)
    score, label = np.round(rng.random(3000) * 1e-6, 9), (rng.random(3000) < 0.02).astype(int)
    df = spark.createDataFrame([(float(s), int(y)) for s, y in zip(score, label)], "probability double, label int")
    got = ranking_metrics(df).collect()[0]
    pos, neg = score[label == 1], score[label == 0]
    want = np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])
    assert got.roc_auc == pytest.approx(want, rel=1e-12)
    curve = {r.probability: (r.tp, r.seen) for r in score_curve(df).collect()}
    assert all(curve[s] == (label[score >= s].sum(), (score >= s).sum()) for s in set(score.tolist()))


def test_corrections_with_many_equal_p_values(spark):
    rng = np.random.default_rng(6)
    p = np.concatenate([np.zeros(300), rng.random(200) * 1e-5, rng.random(100), np.ones(50)])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "k long, p double")
    order = np.lexsort((np.arange(len(p)), p))
    m, rank = len(p), np.empty(len(p))
    rank[order] = np.arange(1, len(p) + 1)
    q = np.minimum.accumulate((p * m / rank)[order][::-1])[::-1].clip(max=1)
    adjusted = np.maximum.accumulate(np.minimum(1, (m - rank[order] + 1) * p[order]))
    got_q = {r.k: r.q for r in I.benjamini_hochberg(df, "p", "q", ["k"]).collect()}
    got_h = {r.k: r.h for r in I.holm(df, "p", "h", ["k"]).collect()}
    np.testing.assert_allclose([got_q[i] for i in order], q, rtol=1e-12)
    np.testing.assert_allclose([got_h[i] for i in order], adjusted, rtol=1e-12)


def brute_nearest(points, place, size):
    d = np.abs(points[:, 1] - place[0]) + np.abs(points[:, 2] - place[1])
    at = np.lexsort((points[:, 0], d))[:size]
    return points[at, 0].astype(int).tolist()


def test_nearest_points_on_lopsided_groups(spark):
    rng = np.random.default_rng(9)
    groups = {
        "even": rng.random((3000, 2)), "clumps": np.concatenate([rng.normal(0, 1e-7, (2500, 2)), rng.normal(50, 1, (500, 2))]),
        "line": np.stack([rng.random(1500), np.zeros(1500)], 1), "spot": np.repeat([[3.0, 4.0]], 1200, 0), "grid": rng.integers(0, 12, (2000, 2)).astype(float), "few": rng.random((4, 2)),
    }
    points = [(g, i, float(u), float(v)) for g, xy in groups.items() for i, (u, v) in enumerate(xy)]
    places = [(g, float(u), float(v)) for g, xy in groups.items() for u, v in np.concatenate([xy[:20], [[-30.0, 7.0], [0.5, 0.5]]])]
    places = list(dict.fromkeys(places))
    got = {}
    found = nearest_points(spark.createDataFrame(points, "g string, id long, u double, v double"), spark.createDataFrame(places + [("none", 0.0, 0.0)], "g string, pu double, pv double"), 10)
    for r in found.orderBy("rank").collect():
        got.setdefault((r.g, r.pu, r.pv), []).append(r.id)
    for g, u, v in places:
        mine = np.array([(i, x, y) for h, i, x, y in points if h == g])
        assert got[(g, u, v)] == brute_nearest(mine, (u, v), 10), g
    assert ("none", 0.0, 0.0) not in got


def test_nearest_points_meet_few_points(spark):
    """At 50,000 different states a place meets a few pages, not its group."""
    df = spark.range(50_000).select(F.lit(1).alias("g"), "id", F.randn(1).alias("u"), F.randn(2).alias("v"))
    places = df.filter("id % 50 = 0").select("g", F.col("u").alias("pu"), F.col("v").alias("pv"))
    from candlemill.operators import neighbours

    met = []
    real = neighbours._within_reach

    def counting(rows, size):
        out = real(rows, size)
        met.append(out.groupBy("g", "pu", "pv").count())
        return out

    neighbours._within_reach = counting
    try:
        nearest_points(df, places, 50).count()
    finally:
        neighbours._within_reach = real
    pages = met[-1].agg(F.avg("count"), F.max("count"), F.count(F.lit(1))).head()
    assert pages[2] == 1000 and pages[0] < 60 and pages[1] < 200  # of 4,167 pages of 12 points
