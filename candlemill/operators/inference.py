"""Run metrics, hypothesis aggregates and multiple-testing control."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from candlemill.config import ALL_PATTERNS, PATTERN_NAMES, ProcedureConfig
from candlemill.functions.student_t import NORMAL_975, mean_ci, positive_mean_p
from candlemill.functions.windows import bucketed_scan
from candlemill.operators.quantiles import exact_medians
from candlemill.sources.series import ordered, sorted_join

HYPOTHESES = (*PATTERN_NAMES, ALL_PATTERNS)


def run_grid(runs: DataFrame, horizons: Sequence[int], names: Sequence[str] = HYPOTHESES) -> DataFrame:
    """Every run with every hypothesis and horizon: the left side that keeps empty runs."""
    return runs.withColumn("hypothesis", F.explode(F.array(*[F.lit(n) for n in names]))).withColumn(
        "horizon", F.explode(F.array(*[F.lit(int(h)) for h in horizons])))


def run_metrics(grid: DataFrame, trades: DataFrame, observations: DataFrame) -> DataFrame:
    """One row per (run, hypothesis, horizon); runs without events keep zeros and NULLs."""
    keys = ["run_id", "hypothesis", "horizon"]
    lost = trades.groupBy(*keys).agg(
        F.count(F.when(F.col("status") == "skipped", 1)).alias("skipped_overlap_count"),
        F.count(F.when(F.col("status") == "untradeable", 1)).alias("untradeable_event_count"))
    matched = F.col("matched_null_mean_net_return").isNotNull() & (F.col("matched_null_count") >= 1)
    hit = F.col("directional_correct").cast("double")
    on = lambda c: F.when(matched, c)
    agg = observations.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count(on(F.lit(1))).alias("matched_null_event_count"),
        F.sum("gross_return").alias("total_gross_return"),
        F.sum("total_transaction_cost").alias("total_transaction_cost"),
        F.sum("net_return").alias("total_net_return"),
        F.avg("net_return").alias("mean_net_return"),
        F.avg(on(F.col("net_return") - F.col("matched_null_mean_net_return"))).alias("mean_effect_vs_matched"),
        F.avg(F.col("net_return") - F.col("unconditional_mean_net_return")).alias("mean_effect_vs_unconditional"),
        F.avg(on(F.col("matched_null_mean_net_return"))).alias("mean_matched_null_net_return"),
        F.avg("unconditional_mean_net_return").alias("mean_unconditional_net_return"),
        F.sum(F.col("directional_correct").cast("long")).alias("direction_correct_count"),
        F.avg(hit).alias("direction_accuracy"),
        F.avg(on(F.col("matched_null_direction_accuracy"))).alias("matched_null_direction_accuracy"),
        F.avg(on(hit)).alias("matched_event_direction_accuracy"),
    )
    middle = exact_medians(observations, keys, "net_return", "median_net_return")
    out = sorted_join(sorted_join(sorted_join(grid, lost, keys, "left"), agg, keys, "left"), middle, keys, "left")
    zero_long = ["skipped_overlap_count", "untradeable_event_count", "event_count", "matched_null_event_count", "direction_correct_count"]
    zero_double = ["total_gross_return", "total_transaction_cost", "total_net_return", "mean_net_return", "median_net_return"]
    return out.withColumns(
        {c: F.coalesce(c, F.lit(0).cast("long")) for c in zero_long}
        | {c: F.coalesce(c, F.lit(0.0)) for c in zero_double})


def _stats(value: Column) -> dict[str, Column]:
    return {"n": F.count(value), "mean": F.avg(value), "sd": F.stddev_samp(value)}


def aggregate_metrics(metrics: DataFrame, procedure: ProcedureConfig = ProcedureConfig()) -> DataFrame:
    """Hypothesis rows per (structure, hypothesis, horizon): seeds are the independent units."""
    c = F.col
    has, matched = c("event_count") > 0, (c("matched_null_event_count") > 0) & c("mean_effect_vs_matched").isNotNull()
    lift = c("matched_event_direction_accuracy") - c("matched_null_direction_accuracy")
    series = {
        "total": c("total_net_return"),
        "net": F.when(has, c("mean_net_return")),
        "effect": F.when(matched, c("mean_effect_vs_matched")),
        "acc": F.when(has, c("direction_accuracy")),
        "lift": F.when(matched, lift),
    }
    weight = c("matched_null_event_count")
    aggs = [v.alias(f"_{k}_{s}") for k, e in series.items() for s, v in _stats(e).items()]
    g = metrics.groupBy("structure_id", "hypothesis", "horizon").agg(
        F.count(F.lit(1)).alias("seed_count_total"),
        F.count(F.when(has, 1)).alias("seed_count_with_events"),
        F.count(F.when(matched, 1)).alias("seed_count_with_matched_nulls"),
        F.sum("event_count").alias("event_count"),
        F.sum("matched_null_event_count").alias("matched_null_event_count"),
        F.sum("skipped_overlap_count").alias("skipped_overlap_count"),
        F.sum("untradeable_event_count").alias("untradeable_event_count"),
        F.sum("total_net_return").alias("net_return_points_sum_across_seeds"),
        F.sum("total_gross_return").alias("_gross"), F.sum("total_transaction_cost").alias("_cost"),
        F.sum(c("mean_net_return") * c("event_count")).alias("_net_w"),
        F.sum("direction_correct_count").alias("_hits"),
        F.avg(F.when(has, c("mean_effect_vs_unconditional"))).alias("mean_effect_vs_unconditional"),
        F.sum(F.when(matched, c("matched_null_direction_accuracy") * weight)).alias("_null_acc_w"),
        F.avg(F.when(matched, c("matched_null_direction_accuracy"))).alias("mean_seed_matched_null_direction_accuracy"),
        *aggs)
    conf = procedure.confidence
    ci = {k: mean_ci(c(f"_{k}_n"), c(f"_{k}_mean"), c(f"_{k}_sd"), conf) for k in series}
    p = {k: positive_mean_p(c(f"_{k}_n"), c(f"_{k}_mean"), c(f"_{k}_sd")) for k in ("effect", "total")}
    per_event = lambda x, default=None: F.coalesce(F.try_divide(x, c("event_count")), F.lit(default).cast("double"))
    out = g.select(
        "structure_id", "hypothesis", "horizon", "seed_count_total", "seed_count_with_events",
        "seed_count_with_matched_nulls", "event_count", "matched_null_event_count", "skipped_overlap_count",
        "untradeable_event_count", "net_return_points_sum_across_seeds",
        ci["total"][0].alias("mean_net_return_points_per_seed"),
        ci["total"][1].alias("mean_net_return_points_per_seed_ci_low"),
        ci["total"][2].alias("mean_net_return_points_per_seed_ci_high"),
        F.lit("fixed_notional_additive_return_points").alias("return_accounting"),
        per_event(c("_gross"), 0.0).alias("mean_gross_return_per_trade"),
        per_event(c("_cost"), 0.0).alias("mean_transaction_cost_per_trade"),
        per_event(c("_net_w"), 0.0).alias("mean_net_return_per_trade"),
        ci["net"][0].alias("mean_seed_net_return"), ci["net"][1].alias("mean_seed_net_return_ci_low"),
        ci["net"][2].alias("mean_seed_net_return_ci_high"),
        ci["effect"][0].alias("mean_effect_vs_matched"), ci["effect"][1].alias("mean_effect_vs_matched_ci_low"),
        ci["effect"][2].alias("mean_effect_vs_matched_ci_high"),
        "mean_effect_vs_unconditional",
        F.when(c("_effect_sd") > 0, c("_effect_mean") / c("_effect_sd")).alias("standardized_seed_effect"),
        ci["acc"][0].alias("direction_accuracy"),
        per_event(c("_hits")).alias("direction_accuracy_event_weighted_descriptive"),
        F.lit("independent_run_or_dependence_cluster").alias("direction_accuracy_inference_unit"),
        F.when(ci["acc"][1].isNotNull(), F.greatest(F.lit(0.0), ci["acc"][1])).alias("direction_accuracy_ci_low"),
        F.when(ci["acc"][2].isNotNull(), F.least(F.lit(1.0), ci["acc"][2])).alias("direction_accuracy_ci_high"),
        F.try_divide(c("_null_acc_w"), c("matched_null_event_count")).alias("matched_null_direction_accuracy"),
        "mean_seed_matched_null_direction_accuracy",
        ci["lift"][0].alias("direction_accuracy_lift_vs_matched"),
        ci["lift"][1].alias("direction_accuracy_lift_ci_low"), ci["lift"][2].alias("direction_accuracy_lift_ci_high"),
        p["effect"].alias("raw_p_value_effect_vs_matched"),
        p["total"].alias("raw_p_value_positive_total_net_return"))
    return out.withColumn("raw_p_value_primary_edge", F.greatest(
        "raw_p_value_effect_vs_matched", "raw_p_value_positive_total_net_return"))


def wilson_interval(hits: Column, trials: Column, z: float = NORMAL_975) -> tuple[Column, Column]:
    n = trials.cast("double")
    p = F.try_divide(hits.cast("double"), n)
    scale = 1.0 + z * z / F.nullif(n, F.lit(0.0))
    centre = (p + z * z / (2.0 * F.nullif(n, F.lit(0.0)))) / scale
    radius = z * F.sqrt((p * (1.0 - p) + z * z / (4.0 * F.nullif(n, F.lit(0.0)))) / F.nullif(n, F.lit(0.0))) / scale
    low, high = F.greatest(F.lit(0.0), centre - radius), F.least(F.lit(1.0), centre + radius)
    return F.when(n > 0, low), F.when(n > 0, high)


def _ranked(rows: DataFrame, p: str, keys: Sequence[str]) -> DataFrame:
    """Rows in the order of their p-value over ranges of equal row numbers; many equal ones are spread by their key."""
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(p)))
    x = ordered(rows.withColumn("_p", clipped), ["_p", *keys]).withColumn("_one", F.lit(1).cast("long"))
    return bucketed_scan(x, [], "_pid", ["_pos"], {"_rank": ("sum", "_one")})


def benjamini_hochberg(rows: DataFrame, p: str, out: str, keys: Sequence[str]) -> DataFrame:
    """q = suffix minimum of p * m / rank, capped at 1."""
    x = _ranked(rows, p, keys)
    m = rows.agg(F.count(F.lit(1))).scalar()
    x = x.withColumn("_m", m).withColumn("_raw", F.col("_p") * F.col("_m") / F.col("_rank"))
    s = bucketed_scan(x, [], "_pid", [F.col("_rank").desc()], {"_q": ("min", "_raw")}, reverse=True)
    return s.withColumn(out, F.least(F.lit(1.0), F.col("_q"))).drop("_p", "_pid", "_pos", "_one", "_rank", "_m", "_raw", "_q")


def holm(rows: DataFrame, p: str, out: str, keys: Sequence[str]) -> DataFrame:
    """Adjusted p = prefix maximum of (m - i) * p over ascending p."""
    x = _ranked(rows, p, keys)
    m = rows.agg(F.count(F.lit(1))).scalar()
    x = x.withColumn("_m", m).withColumn(
        "_raw", F.least(F.lit(1.0), (F.col("_m") - F.col("_rank") + 1) * F.col("_p")))
    s = bucketed_scan(x, [], "_pid", [F.col("_rank")], {"_adj": ("max", "_raw")})
    return s.withColumn(out, F.col("_adj")).drop("_p", "_pid", "_pos", "_one", "_rank", "_m", "_raw", "_adj")


KEYS = ("structure_id", "hypothesis", "horizon")


def supported(p: str, procedure: ProcedureConfig) -> Column:
    """The conjunctive support, profit and significance filter of discovery and validation."""
    c = F.col
    return F.coalesce(
        (c("event_count") >= procedure.min_events) & (c("matched_null_event_count") >= procedure.min_events)
        & (c("seed_count_with_events") >= procedure.min_seeds) & (c("seed_count_with_matched_nulls") >= procedure.min_seeds)
        & (c("mean_net_return_per_trade") > 0) & (c("mean_effect_vs_matched") > 0) & (c(p) <= procedure.alpha),
        F.lit(False))


def select_discovery(rows: DataFrame, procedure: ProcedureConfig = ProcedureConfig(), keys: Sequence[str] = KEYS) -> DataFrame:
    q = benjamini_hochberg(rows, "raw_p_value_primary_edge", "discovery_fdr_q_value", keys)
    return q.filter(supported("discovery_fdr_q_value", procedure)).orderBy(
        "discovery_fdr_q_value", F.desc("mean_effect_vs_matched"), F.desc("mean_net_return_per_trade"),
        F.desc("event_count"), *keys).limit(procedure.top_k)


def validate_selected(
    validation: DataFrame, selected: DataFrame, procedure: ProcedureConfig = ProcedureConfig(), keys: Sequence[str] = KEYS
) -> DataFrame:
    """Holm over the pre-selected hypotheses only."""
    rows = validation.join(selected.select(*keys).distinct(), list(keys), "left_semi")
    out = holm(rows, "raw_p_value_primary_edge", "validation_holm_p_value", keys)
    return out.withColumn("validated", supported("validation_holm_p_value", procedure))


def missing_or_repeated(validation: DataFrame, selected: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Selected keys without exactly one validation row."""
    n = validation.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return selected.select(*keys).distinct().join(n, list(keys), "left").filter(F.coalesce("rows", F.lit(0)) != 1)


def structure_rankings(validated: DataFrame) -> DataFrame:
    """Best hypothesis and best all-pattern portfolio of each structure, ranked (NULLs last)."""
    c = F.col
    best = F.struct("mean_net_return_per_trade", "mean_effect_vs_matched", (-c("validation_holm_p_value")).alias("np"), "hypothesis", "horizon")
    folio = F.when(c("hypothesis") == ALL_PATTERNS, F.struct("mean_net_return_points_per_seed", (-c("horizon")).alias("nh"), "horizon"))
    row = F.struct("hypothesis", "horizon", "mean_net_return_per_trade", "mean_effect_vs_matched", "validation_holm_p_value", "event_count")
    g = validated.filter("validated").groupBy("structure_id").agg(
        F.count(F.lit(1)).alias("validated_hypothesis_count"), F.max_by(row, best).alias("b"), F.max(folio).alias("f"))
    out = g.select(
        "structure_id", "validated_hypothesis_count", c("b.hypothesis").alias("best_pattern"), c("b.horizon").alias("best_horizon"),
        c("b.mean_net_return_per_trade").alias("best_mean_net_return_per_trade"),
        c("b.mean_effect_vs_matched").alias("best_mean_effect_vs_matched"),
        c("b.validation_holm_p_value").alias("best_validation_holm_p_value"), c("b.event_count").alias("best_event_count"),
        c("f.horizon").alias("best_portfolio_horizon"),
        c("f.mean_net_return_points_per_seed").alias("best_portfolio_mean_net_return_points_per_seed"))
    order = ["_folio", "_net", "best_validation_holm_p_value", "structure_id"]
    worst = F.lit(float("inf"))
    x = ordered(out.withColumns({
        "_folio": F.coalesce(-c("best_portfolio_mean_net_return_points_per_seed"), worst), "_net": F.coalesce(-c("best_mean_net_return_per_trade"), worst),
        "_one": F.lit(1).cast("long")}), order)
    ranked = bucketed_scan(x, [], "_pid", ["_pos"], {"rank": ("sum", "_one")})
    return ranked.select(*out.columns, c("rank").cast("int").alias("rank"))


def pool_clusters(metrics: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Collapse the runs of one dependence cluster to a single unit before inference."""
    c = F.col

    def weighted(field: str, weight: str) -> Column:
        ok = c(weight) > 0
        return F.try_divide(F.sum(F.when(ok, c(field) * c(weight))), F.sum(F.when(ok, c(weight)))).alias(field)

    events, nulls = "event_count", "matched_null_event_count"
    # All weighted means are taken over the input counts, so they are computed next to the sums.
    src = metrics.withColumns({"_e": c(events), "_m": c(nulls)})
    w = lambda f, k: weighted(f, "_e" if k == events else "_m")
    out = src.groupBy(cluster, "hypothesis", "horizon").agg(
        F.sum("_e").alias(events), F.sum("_m").alias(nulls),
        *[F.sum(k).alias(k) for k in ("skipped_overlap_count", "untradeable_event_count", "total_gross_return",
                                      "total_transaction_cost", "total_net_return", "direction_correct_count")],
        w("mean_net_return", events), w("mean_effect_vs_matched", nulls), w("mean_effect_vs_unconditional", events),
        w("mean_matched_null_net_return", nulls), w("mean_unconditional_net_return", events),
        w("matched_null_direction_accuracy", nulls), w("matched_event_direction_accuracy", nulls))
    return out.withColumns({
        "mean_net_return": F.coalesce("mean_net_return", F.lit(0.0)),
        "median_net_return": F.lit(None).cast("double"),
        "direction_accuracy": F.try_divide(c("direction_correct_count"), c(events)),
        "structure_id": F.lit("REAL-POOLED"),
        "run_id": F.concat(F.lit("REAL-CLUSTER-"), c(cluster).cast("string")),
    })


def pooled_validation(metrics: DataFrame, procedure: ProcedureConfig = ProcedureConfig(), cluster: str = "cluster") -> DataFrame:
    rows = aggregate_metrics(pool_clusters(metrics, cluster), procedure)
    out = holm(rows, "raw_p_value_primary_edge", "real_holm_p_value", KEYS)
    return out.withColumn("real_validated", supported("real_holm_p_value", procedure))
