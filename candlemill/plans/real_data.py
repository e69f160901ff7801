"""Validation on declared price files: manifest and CSV in, pooled hypotheses out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from candlemill.config import PatternConfig, ProcedureConfig
from candlemill.operators import checks as C, inference as I
from candlemill.operators.dependence import dependence_clusters, overlap_pairs
from candlemill.plans.studies import pattern_study
from candlemill.sources import files as R
from candlemill.sources.series import written


def declared_bars(spark: SparkSession, manifest: str, csv: str) -> tuple[DataFrame, DataFrame]:
    """Declarations and numbered bars of the files under ``csv``, after all checks; any violation stops the load.

    Files and declarations meet on the full path, so equal base names in two folders are two datasets, whatever the order of
    their columns.
    """
    declared = written(R.read_manifest(spark, manifest).withColumn("input_order", F.monotonically_increasing_id()), "declared")
    C.require_none(C.bad_specs(declared), "a dataset is not declared well enough")
    if declared.select("timeframe").distinct().count() > 1:
        raise ValueError("datasets of one pooled study share one bar length")
    rows = written(R.read_ohlcv(spark, csv), "ohlcv")
    C.require_none(R.manifest_mismatch(declared, rows), "files and declarations differ")
    C.require_none(C.bad_csv_rows(rows), "unreadable or impossible prices")
    C.require_none(C.duplicate_keys(rows, ["run_id", "ts"]), "a bar stands twice")
    bars = written(R.indexed_bars(rows), "bars")
    C.require_none(C.irregular_spacing(bars, timeframe=declared.select("timeframe").head()[0]), "bars are not spaced as declared")
    return declared, bars


def dataset_windows(declared: DataFrame, bars: DataFrame) -> DataFrame:
    """First and last second of every dataset beside its declaration; a bar lasts its declared length."""
    span = bars.groupBy("run_id").agg(F.min(F.unix_seconds("ts")).alias("start"), F.max(F.unix_seconds("ts")).alias("last"), F.count(F.lit(1)).alias("bars"))
    length = C.timeframe_seconds(declared.select("timeframe").head()[0])
    return span.join(declared, "run_id").select(
        F.col("run_id").alias("dataset_id"), "asset", F.col("start").cast("double").alias("start"), (F.col("last") + length).cast("double").alias("end"), "bars",
        "dependence_group", "input_order")


def real_data_validation(
    spark: SparkSession, manifest: str, csv: str, *, embargo: float = 0.0, config: PatternConfig = PatternConfig(), procedure: ProcedureConfig = ProcedureConfig(),
) -> dict[str, DataFrame]:
    """Datasets, their dependence clusters, the pattern study over all of them, and hypotheses pooled with one unit per cluster.

    Two datasets of one asset may not overlap in time: their trades would count twice. Datasets that overlap within
    ``embargo`` seconds, or that declare one dependence group, are one unit of inference.
    """
    declared, bars = declared_bars(spark, manifest, csv)
    windows = written(dataset_windows(declared, bars), "dataset-windows")
    width = windows.agg(F.avg(F.col("end") - F.col("start"))).head()[0] or 1.0
    twice = overlap_pairs(windows, 0.0, width=max(width, 1.0)).filter("same_asset_overlap")
    C.require_none(twice, "datasets of one asset overlap")
    clusters = written(dependence_clusters(windows, embargo), "clusters")
    runs = clusters.select(F.col("dataset_id").alias("run_id"), F.lit("REAL-POOLED").alias("structure_id"), F.col("input_order").alias("seed"))
    study = pattern_study(bars, runs, config, procedure)
    metrics = study["metrics"].join(clusters.select(F.col("dataset_id").alias("run_id"), F.col("cluster_id").alias("cluster")), "run_id")
    return study | {"datasets": windows, "dependence": clusters, "metrics": metrics, "pooled": I.pooled_validation(metrics, procedure)}
