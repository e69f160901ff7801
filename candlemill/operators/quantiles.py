"""Exact quantiles of any group size by histogram refinement.

Every round counts values per bucket, map-side, and keeps only the buckets that hold a wanted rank; these are cut again
between their own least and greatest value until they hold one value. The first buckets lie on a logarithmic scale that needs
no knowledge of the data, so one scan serves all groups. What is shuffled are bucket counts; rows of kept buckets are
written once after the first round, and shrink from then on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from candlemill.sources.series import sorted_join, written

BINS = 4096
STEPS = 64.0  # first buckets for each factor of e
FINEST = 1e12  # values below 1 / FINEST share a bucket at first
BROADCAST_ROWS = 10_000


def _first_bucket(x: Column) -> Column:
    """A bucket number that never falls as ``x`` rises; the two signs never share one, and zero has its own."""
    size = F.floor(F.log1p(F.abs(x) * FINEST) * STEPS).cast("long") + 1
    return F.when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0).cast("long"))


def _inside(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.floor((x - low) / (high - low) * BINS), F.lit(BINS - 1)).cast("long")


def _kept(rows: DataFrame, few: DataFrame) -> DataFrame:
    """Rows of the buckets that are cut again, with the next bucket number."""
    few = F.broadcast(few) if few.count() <= BROADCAST_ROWS else few.hint("merge")
    met = rows.join(few.withColumnRenamed("_before", "_next"), ["_k", "_at", "_b"])
    return met.select("_k", F.col("_next").alias("_at"), "_x", _inside(F.col("_x"), F.col("_low"), F.col("_high")).alias("_b"))


def exact_quantiles(rows: DataFrame, keys: Sequence[str], value: Column | str, cuts: Sequence[float], name: str = "quantiles") -> DataFrame:
    """``keys`` and an array ``name`` with the quantile of ``value`` at each of ``cuts``, between neighbours by linear interpolation.

    Nulls and not-a-number are left out; a group of nothing else gives no row. Groups may be of any size and
    hold any number of equal values. Values are finite.
    """
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))
    now = rows.select(group.alias("_k"), F.lit(0).cast("long").alias("_at"), x.alias("_x"), _first_bucket(x).alias("_b")).filter("_x IS NOT NULL AND NOT isnan(_x)")
    n, wanted, solved = None, None, []
    while True:
        counted = now.groupBy("_k", "_at", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
        before = Window.partitionBy("_k", "_at").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        counted = written(counted.withColumn("_before", F.col("_at") + F.coalesce(F.sum("_n").over(before), F.lit(0))), "quantile-counts")
        if n is None:
            n = written(counted.groupBy("_k").agg(F.sum("_n").alias("_n")), "quantile-sizes")
            place = F.explode(F.array(*[F.struct(F.floor(F.lit(float(c)) * (F.col("_n") - 1)).cast("long").alias("a"), F.ceil(F.lit(float(c)) * (F.col("_n") - 1)).cast("long").alias("b")) for c in cuts]))
            wanted = n.select("_k", place.alias("p")).select("_k", F.explode(F.array("p.a", "p.b")).alias("rank")).distinct()
            wanted = wanted.withColumn("_at", F.lit(0).cast("long"))
        met = sorted_join(wanted, counted, ["_k", "_at"]).filter((F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_n")))
        met = written(met.select("_k", "rank", "_at", "_b", "_before", "_low", "_high"), "quantile-places")
        solved.append(met.filter("_low = _high").select("_k", "rank", F.col("_low").alias("value")))
        still = met.filter("_low < _high")
        if not still.head(1):
            break
        now = written(_kept(now, still.select("_k", "_at", "_b", "_before", "_low", "_high").distinct()), "quantile-rows")
        wanted = still.select("_k", "rank", F.col("_before").alias("_at"))
    values = solved[0]
    for more in solved[1:]:
        values = values.unionByName(more)
    held = values.groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_v"))  # two ranks a cut

    def between(cut: float) -> Column:
        at = F.lit(float(cut)) * (F.col("_n") - 1)
        a, b = F.col("_v")[F.floor(at).cast("long")], F.col("_v")[F.ceil(at).cast("long")]
        return F.when(a == b, a).otherwise((F.ceil(at) - at) * a + (at - F.floor(at)) * b)

    return sorted_join(n, held, "_k").select(*[F.col(f"_k.`{k}`").alias(k) for k in keys], F.array(*[between(c) for c in cuts]).alias(name))


def exact_medians(rows: DataFrame, keys: Sequence[str], value: Column | str, name: str) -> DataFrame:
    """``keys`` and the exact median of ``value``; a group without values has no row."""
    return exact_quantiles(rows, keys, value, [0.5], "_q").select(*keys, F.col("_q")[0].alias(name))
