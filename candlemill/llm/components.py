"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from candlemill.sources.series import written


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (smallest node of the component) for every node that has an edge to another node.

    ``edges`` has two long columns ``a``, ``b``. A round joins each node with the minimum of its neighbours, first
    towards larger neighbours, then towards smaller ones; the rounds grow with the logarithm of a component's
    diameter. Minima are partial aggregates and the joins are plain, so a node with many neighbours can be split.
    Each round is one job: it is written to the shared folder, and its count and checksum are observed on the way.
    """

    def kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        rows = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), total.alias("sum")), "edges")
        return rows, (seen.get["n"], seen.get["sum"])

    now, before = kept(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now, after = kept(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        if after == before:
            break
        before = after
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
