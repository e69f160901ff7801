"""Ordered series: number the rows of every run without a per-run sort task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from candlemill.session import scratch_path

_KNOWN: dict[tuple, str] = {}

# fixed value: tables of offsets up to this many small rows go to every task, larger ones are joined by sorting
OFFSET_ROWS = 400_000


def number_series(
    df: DataFrame,
    run: str,
    order: Sequence[str],
    *,
    step: str = "step",
    running: Mapping[str, str] | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add a dense 0-based ``step`` per run, and optional running sums, in global order.

    Rows are range-partitioned on (run, order), so a hot run is spread over many partitions. The
    sorted rows are written once; each file knows its partition number and row positions, and a
    table with one row per (partition, run) carries the offsets between files. That table goes to the
    rows and not they to it, unless it has more than ``OFFSET_ROWS``. Of the columns only ``keep`` are written (default: all); the
    others serve the order alone.
    """
    spark = df.sparkSession
    running = dict(running or {})
    keys = [run, *order]
    keep = list(df.columns if keep is None else keep)
    staged = scratch_path(spark, "ordered")
    (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select(*dict.fromkeys([run, *keep, *running.values()]), F.spark_partition_id().alias("_pid"),
                F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos"))
        .write.parquet(staged)
    )
    rows = spark.read.parquet(staged)
    parts = rows.groupBy(run, "_pid").agg(
        F.min("_pos").alias("_first"),
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(src).alias(f"_s_{name}") for name, src in running.items()],
    )
    before = Window.partitionBy(run).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        run, "_pid", "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
        *[F.coalesce(F.sum(f"_s_{name}").over(before), F.lit(0)).alias(f"_b_{name}") for name in running],
    )
    offsets = written(offsets, "offsets")
    offsets = F.broadcast(offsets) if offsets.count() <= OFFSET_ROWS else offsets.hint("merge")
    out = rows.join(offsets, [run, "_pid"]).withColumn(step, F.col("_pos") - F.col("_first") + F.col("_base"))
    inside = Window.partitionBy(run, "_pid").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    for name, src in running.items():
        out = out.withColumn(name, F.sum(src).over(inside) + F.col(f"_b_{name}"))
    return out.select(*keep, step, *running)


def ordered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` written in the order of ``order``, with ``_pid`` and ``_pos``: part and place inside it.

    The parts are ranges whose borders come from a sample of the rows, so they hold about equally many whatever the values;
    end ``order`` with a key to let many equal values spread over parts. Together (``_pid``, ``_pos``) is the bucket and order
    of a bucketed scan.
    """
    staged = scratch_path(df.sparkSession, "ordered")
    (
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        .write.parquet(staged)
    )
    return df.sparkSession.read.parquet(staged)


def sorted_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the input, never by broadcast.

    Size estimates count compressed files and no exploded rows, so Spark would take some of them for small and collect hundreds of
    megabytes in the driver.
    """
    return left.join(right.hint("merge"), on, how)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table to the shared scratch folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def stored(spark: SparkSession, key: tuple, build) -> DataFrame:
    """Build a table once per session and source, then read it back as Parquet."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _KNOWN:
        path = scratch_path(spark, "-".join(str(k).strip("/").replace("/", "_") for k in key))
        build().write.parquet(path)
        _KNOWN[full] = path
    return spark.read.parquet(_KNOWN[full])
