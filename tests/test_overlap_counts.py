"""Overlap counts against the pairs they stand for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlemill.operators import dependence as J


def test_above_before_against_all_places():
    draw = np.random.default_rng(3)
    for m in (0, 1, 2, 7, 64, 100):
        k, n = draw.integers(0, 9, m), draw.integers(0, 4, m)
        assert J.above_before(k, n).tolist() == [int(n[:i][k[:i] > k[i]].sum()) for i in range(m)]


@pytest.mark.parametrize("embargo, scale", [(0.0, 1.0), (2.0, 1.0), (0.5, 0.137)])
def test_counts_against_pairs(spark, embargo, scale):
    """Equal instants, windows of no length, assets that differ in case only or are missing; blocks and parts of a few rows."""
    draw = np.random.default_rng(7)
    start = draw.integers(0, 60, 400) * scale
    rows = [(int(i) * 3, ["x", "X", "y", None][int(a)], float(s), float(s + w * scale)) for i, a, s, w in zip(
        draw.permutation(400), draw.integers(0, 4, 400), start, draw.integers(0, 4, 400))]
    w = spark.createDataFrame(rows, "dataset_id long, asset string, start double, end double")
    want = J.overlap_pairs(w, embargo, width=2.0).groupBy("a").agg(
        F.count(F.lit(1)).alias("met"), F.count(F.when(F.col("same_asset_overlap"), 1)).alias("same_asset"))
    got = J.overlap_counts(w, embargo, block=16, part=32)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_counts_form_no_pairs(spark):
    """Every window meets every other: the pairs would be 2 * 10^9."""
    n = 65_536
    w = spark.range(n).select(F.col("id").alias("dataset_id"), F.lit("x").alias("asset"), F.lit(1.0).alias("start"), F.lit(2.0).alias("end"))
    row = J.overlap_counts(w, 0.0, block=8_192).agg(F.sum("met"), F.sum("same_asset"), F.max("met")).head()
    assert tuple(row) == (n * (n - 1) // 2, n * (n - 1) // 2, n - 1)
