"""Classifier metrics as aggregates: exact ranking metrics by score, histogram ones by bin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from candlemill.functions.windows import bucketed_scan
from candlemill.operators.quantiles import exact_quantiles
from candlemill.sources.series import ordered

CALIBRATION_EDGES = tuple(i * 0.1 for i in range(11))


def score_curve(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Positives and rows at or above each distinct score.

    Scores are pre-aggregated, so a heavy score is one row, and scanned over ranges of equal row numbers: scores of a rare
    event, all next to zero, spread over all tasks.
    """
    g = rows.groupBy(*keys, "probability").agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n"))
    g = ordered(g, [*keys, "probability"])
    return bucketed_scan(g, keys, "_pid", [F.col("_pos").desc()], {"tp": ("sum", "pos"), "seen": ("sum", "n")}, reverse=True)


def ranking_metrics(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Exact ROC-AUC (ties count half) and average precision; NULL with one class only."""
    c = score_curve(rows, keys)
    neg = F.col("n") - F.col("pos")
    # Of each score: its negatives beat by higher positives, plus half of the tied pairs.
    won = neg * (F.col("tp") - F.col("pos")) + 0.5 * neg * F.col("pos")
    a = c.groupBy(*keys).agg(
        F.sum("pos").alias("P"), F.sum(neg).alias("N"), F.sum(won).alias("_w"),
        F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("_ap"))
    both = (F.col("P") > 0) & (F.col("N") > 0)
    return a.select(
        *keys,
        F.when(both, F.try_divide(F.col("_w").cast("double"), F.col("P") * F.col("N"))).alias("roc_auc"),
        F.when(both, F.try_divide(F.col("_ap"), F.col("P"))).alias("average_precision"))


def histogram_ranking(rows: DataFrame, keys: Sequence[str] = (), *, bins: int = 4096) -> DataFrame:
    """Fixed-bin approximation of both ranking metrics; at most ``bins`` rows per key are scanned."""
    b = F.least(F.floor(F.col("probability") * bins), F.lit(bins - 1)).cast("long")
    h = rows.groupBy(*keys, b.alias("bin")).agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumns({"tp": F.sum("pos").over(w), "seen": F.sum("n").over(w)})
    neg = F.col("n") - F.col("pos")
    a = h.groupBy(*keys).agg(
        F.sum("pos").alias("P"), F.sum(neg).alias("N"),
        F.sum(neg * (F.col("tp") - F.col("pos")) + 0.5 * neg * F.col("pos")).alias("_w"),
        F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("_ap"))
    return a.select(
        *keys, F.try_divide(F.col("_w").cast("double"), F.col("P") * F.col("N")).alias("roc_auc"),
        F.try_divide(F.col("_ap"), F.col("P")).alias("average_precision"))


def calibration_bin(p: Column, bins: int = 10) -> Column:
    """Bin by counting the literal edges at or below p (floor(10 p) differs at 0.3); last bin closed."""
    edges = [i * (1.0 / bins) for i in range(1, bins)]
    return sum((F.when(p >= e, 1).otherwise(0) for e in edges), F.lit(0))


def threshold_metrics(rows: DataFrame, threshold: float, keys: Sequence[str] = ()) -> DataFrame:
    """Brier score and accuracy, precision, recall at a threshold (0 on an empty denominator)."""
    hit = F.col("probability") >= threshold
    y = F.col("label") == 1
    a = rows.groupBy(*keys).agg(
        F.avg((F.col("probability") - F.col("label")) * (F.col("probability") - F.col("label"))).alias("brier_score"),
        F.avg((hit == y).cast("double")).alias("accuracy_at_threshold"),
        F.count(F.when(hit & y, 1)).alias("_tp"), F.count(F.when(hit, 1)).alias("_pp"), F.count(F.when(y, 1)).alias("_p"))
    return a.select(
        *keys, "brier_score", "accuracy_at_threshold",
        (F.col("_tp") / F.greatest(F.col("_pp"), F.lit(1))).alias("precision_at_threshold"),
        (F.col("_tp") / F.greatest(F.col("_p"), F.lit(1))).alias("recall_at_threshold"))


def calibration_error(rows: DataFrame, keys: Sequence[str] = (), bins: int = 10) -> DataFrame:
    b = rows.groupBy(*keys, calibration_bin(F.col("probability"), bins).alias("bin")).agg(
        F.sum("label").alias("_y"), F.sum("probability").alias("_q"), F.count(F.lit(1)).alias("_n"))
    return b.groupBy(*keys).agg((F.sum(F.abs(F.col("_y") - F.col("_q"))) / F.sum("_n")).alias("expected_calibration_error"))


def calibration_table(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Fixed-bin table; empty bins are dropped."""
    b = rows.groupBy(calibration_bin(F.col("probability"), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.avg("probability").alias("mean_probability"), F.avg("label").alias("observed_success_rate"))
    return b.select((F.col("bin") / bins).alias("bin_lower"), ((F.col("bin") + 1) / bins).alias("bin_upper"),
                    "count", "mean_probability", "observed_success_rate")


def quantile_calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Calibration by score quantiles (inner edges from exact percentiles, empty bins dropped)."""
    cuts = [i / bins for i in range(1, bins)]
    edges = exact_quantiles(rows, [], "probability", cuts, "_e")
    x = rows.crossJoin(F.broadcast(edges))  # one row
    x = x.withColumn("bin", F.size(F.filter("_e", lambda e: e < F.col("probability"))))
    return x.groupBy("bin").agg(F.count(F.lit(1)).alias("count"), F.avg("probability").alias("mean_predicted_probability"),
                                F.avg("label").alias("observed_success_rate"))


def log_loss(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    p = F.least(F.greatest(F.col("probability"), F.lit(1e-15)), F.lit(1.0 - 1e-15))
    y = F.col("label")
    return rows.groupBy(*keys).agg(F.avg(-y * F.log(p) - (1 - y) * F.log1p(-p)).alias("log_loss"))


def classification_metrics(rows: DataFrame, threshold: float, keys: Sequence[str] = ()) -> DataFrame:
    if keys:
        k = list(keys)
        return ranking_metrics(rows, k).join(threshold_metrics(rows, threshold, k), k).join(calibration_error(rows, k), k)
    one = lambda df: df.withColumn("_k", F.lit(1))
    return one(ranking_metrics(rows)).join(one(threshold_metrics(rows, threshold)), "_k").join(one(calibration_error(rows)), "_k").drop("_k")


def compare_scorers(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Differences of two probability columns on the same rows, with the acceptance bounds."""
    first, second = (rows.withColumn("probability", F.col(c)) for c in (a, b))
    both = lambda f: (f(first).withColumn("_k", F.lit(1)), f(second).withColumn("_k", F.lit(1)))
    gap = rows.agg(F.avg(F.abs(F.col(a) - F.col(b))).alias("probability_mae"),
                   F.avg((F.col(a) - F.col("label")) * (F.col(a) - F.col("label"))).alias("_ba"),
                   F.avg((F.col(b) - F.col("label")) * (F.col(b) - F.col("label"))).alias("_bb")).withColumn("_k", F.lit(1))
    la, lb = both(log_loss)
    ea, eb = both(calibration_error)
    out = (
        gap.join(la.withColumnRenamed("log_loss", "_la"), "_k").join(lb.withColumnRenamed("log_loss", "_lb"), "_k")
        .join(ea.withColumnRenamed("expected_calibration_error", "_ea"), "_k")
        .join(eb.withColumnRenamed("expected_calibration_error", "_eb"), "_k")
    )
    out = out.select("probability_mae", (F.col("_lb") - F.col("_la")).alias("log_loss_difference"),
                     (F.col("_bb") - F.col("_ba")).alias("brier_difference"), (F.col("_eb") - F.col("_ea")).alias("ece_difference"))
    # fixed values: acceptance bounds of the comparison
    return out.withColumn("accepted", (F.col("probability_mae") < 0.05) & (F.col("log_loss_difference") < 0.02)
                          & (F.col("brier_difference") < 0.01) & (F.col("ece_difference") < 0.03))


def choose_threshold(metrics: DataFrame, min_trades: int, min_runs: int) -> DataFrame:
    """Best supported threshold: highest mean run return, then more runs, then the lower threshold.
    No row comes back when none is supported; the caller must then stop."""
    ok = (F.col("selected_trades") >= min_trades) & (F.col("selected_runs") >= min_runs) & F.col("mean_run_net_return_points").isNotNull()
    return metrics.filter(ok).orderBy(F.desc("mean_run_net_return_points"), F.desc("selected_runs"), "threshold").limit(1)


def require_threshold(metrics: DataFrame, min_trades: int, min_runs: int) -> float:
    best = choose_threshold(metrics, min_trades, min_runs).head()
    if best is None:
        raise ValueError("no threshold has enough validation trades and runs; evaluation on test data is disabled")
    return float(best["threshold"])


def choose_primary(comparison: DataFrame) -> DataFrame:
    """Mark the primary model by validation results only; its p-value is doubled, others get none."""
    best = comparison.orderBy(
        F.col("validation_roc_auc").desc_nulls_last(), F.col("validation_brier_score").asc_nulls_last(),
        F.col("validation_mean_run_net_return_points").desc_nulls_last(), "model").limit(1).select(F.col("model").alias("_best"))
    out = comparison.join(best, comparison.model == best["_best"], "left").withColumn("primary_model", F.col("_best").isNotNull()).drop("_best")
    return out.withColumn("confirmatory_p_value", F.when(F.col("primary_model"), F.least(F.lit(1.0), 2 * F.col("uplift_p_value"))))
