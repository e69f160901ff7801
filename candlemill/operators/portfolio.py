"""Economic metrics of a trade selection over the complete run universe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from candlemill.functions.student_t import mean_ci, positive_mean_p
from candlemill.functions.windows import CHUNK, bucketed_scan
from candlemill.operators.overlap import select_trades
from candlemill.operators.quantiles import exact_medians, exact_quantiles
from candlemill.sources.series import written


def run_drawdown(trades: DataFrame, keys: Sequence[str], value: str, order: str, *, chunk: int = 65_536) -> DataFrame:
    """Largest fall of an additive path from its running peak, the path starting at 0.

    Two bucketed scans (running sum, running peak) instead of one ordered pass per run.
    """
    x = trades.withColumn("_b", F.floor(F.col(order) / chunk).cast("long"))
    x = bucketed_scan(x, keys, "_b", [order], {"_cum": ("sum", value)})
    x = bucketed_scan(x, keys, "_b", [order], {"_peak": ("max", "_cum")})
    fall = F.greatest(F.lit(0.0), F.col("_peak")) - F.col("_cum")
    return x.groupBy(*keys).agg(F.max(fall).alias("max_drawdown"))


def structure_units(runs: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Inference units: the mean over the runs of each structure, empty runs included."""
    return runs.groupBy(*keys, "structure_id").agg(F.avg(value).alias("unit"))


def unit_interval(units: DataFrame, keys: Sequence[str] = (), confidence: float = 0.95) -> DataFrame:
    g = units.groupBy(*keys).agg(
        F.count("unit").alias("inference_structures"), F.avg("unit").alias("_m"), F.stddev_samp("unit").alias("_sd"))
    m, lo, hi = mean_ci(F.col("inference_structures"), F.col("_m"), F.col("_sd"), confidence)
    p = positive_mean_p(F.col("inference_structures"), F.col("_m"), F.col("_sd"))
    return g.select(*keys, "inference_structures", m.alias("mean_unit"), lo.alias("ci_low"), hi.alias("ci_high"), p.alias("p_value"))


def run_totals(universe: DataFrame, picked: DataFrame, keys: Sequence[str], grid: DataFrame | None = None) -> DataFrame:
    """Total return and drawdown of every run of the universe; runs without trades count as zero."""
    total = picked.groupBy(*keys, "run_id").agg(F.sum("net_directional_return").alias("_t"), F.count(F.lit(1)).alias("_n"))
    fall = run_drawdown(picked, [*keys, "run_id"], "net_directional_return", "entry_index")
    base = universe if grid is None else grid
    on = [*keys, "run_id"]
    return base.join(total, on, "left").join(fall, on, "left").withColumns({
        "run_return": F.coalesce("_t", F.lit(0.0)), "run_trades": F.coalesce("_n", F.lit(0).cast("long")),
        "max_drawdown": F.coalesce("max_drawdown", F.lit(0.0))}).drop("_t", "_n")


def economic_metrics(rows: DataFrame, universe: DataFrame, thresholds: Sequence[float], max_hold: int) -> DataFrame:
    """One row per threshold: selection counts, returns, run totals and structure-level interval."""
    scored = written(select_trades(rows, thresholds, max_hold), "selection")
    picked = scored.filter("executed")
    keys = ["threshold"]
    every = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    grid = universe.select("run_id", "structure_id").withColumn("threshold", every)
    per_run = written(run_totals(universe, picked, keys, grid), "run-totals")
    ci = unit_interval(structure_units(per_run, "run_return", keys), keys)
    runs = per_run.groupBy("threshold").agg(
        F.count(F.when(F.col("run_trades") > 0, 1)).alias("selected_runs"),
        F.avg("max_drawdown").alias("mean_run_max_drawdown_return_points"))
    all_rows = rows.agg(F.count(F.lit(1))).scalar()
    cand = scored.groupBy("threshold").agg(
        F.count(F.lit(1)).alias("candidate_selected_trades"),
        F.count(F.when(F.col("executed"), 1)).alias("selected_trades"),
        F.avg(F.when(F.col("executed"), F.col("profitable"))).alias("selected_success_rate"),
        F.avg(F.when(F.col("executed"), F.col("net_directional_return"))).alias("mean_selected_net_return"))
    cand = cand.join(exact_medians(picked, keys, "net_directional_return", "median_selected_net_return"), keys, "left")
    runs = runs.join(exact_medians(per_run, keys, "run_return", "median_run_net_return_points"), keys)
    out = runs.join(ci, keys).join(cand, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return out.select(
        "threshold", zero("candidate_selected_trades").alias("candidate_selected_trades"), zero("selected_trades").alias("selected_trades"),
        "selected_runs", "inference_structures", (zero("selected_trades") / F.greatest(F.lit(1), all_rows)).alias("selection_rate"),
        "selected_success_rate", "mean_selected_net_return", "median_selected_net_return",
        F.col("mean_unit").alias("mean_run_net_return_points"), F.col("ci_low").alias("mean_run_net_return_points_ci_low"),
        F.col("ci_high").alias("mean_run_net_return_points_ci_high"), "median_run_net_return_points",
        "mean_run_max_drawdown_return_points")


def baseline_metrics(rows: DataFrame, universe: DataFrame, max_hold: int) -> DataFrame:
    """Every signal taken: the same metrics at probability one, prefixed."""
    out = economic_metrics(rows.withColumn("probability", F.lit(1.0)), universe, [0.5], max_hold).drop("threshold")
    return out.withColumnsRenamed({c: f"baseline_{c}" for c in out.columns})


def paired_uplift(rows: DataFrame, universe: DataFrame, threshold: float, max_hold: int) -> DataFrame:
    """Filtered minus unfiltered return of each run, averaged per structure before inference."""
    total = lambda df, name: df.filter("executed").groupBy("run_id").agg(F.sum("net_directional_return").alias(name))
    model = total(select_trades(rows, [threshold], max_hold), "_a")
    base = total(select_trades(rows.withColumn("probability", F.lit(1.0)), [0.5], max_hold), "_b")
    d = universe.select("run_id", "structure_id").join(model, "run_id", "left").join(base, "run_id", "left").withColumn(
        "uplift", F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))
    share = d.agg(
        F.avg((F.col("uplift") > 0).cast("double")).alias("outperforms_run_fraction"),
        F.avg((F.col("uplift") == 0).cast("double")).alias("equals_run_fraction"),
        F.count(F.lit(1)).alias("evaluation_runs"))
    ci = unit_interval(structure_units(d, "uplift"))
    return ci.withColumn("_k", F.lit(1)).join(share.withColumn("_k", F.lit(1)), "_k").select(
        F.col("mean_unit").alias("mean_uplift"), F.col("ci_low").alias("uplift_ci_low"), F.col("ci_high").alias("uplift_ci_high"),
        F.col("p_value").alias("uplift_p_value"), "outperforms_run_fraction", "equals_run_fraction", "evaluation_runs", "inference_structures")


def family_of(world_family: Column) -> Column:
    return F.when(world_family == "structured", "structured").when(world_family.startswith("null_"), "null")


def by_family(rows: DataFrame, universe: DataFrame, threshold: float, max_hold: int) -> DataFrame:
    """Structured and null families apart, so that telling them apart is not mistaken for skill."""
    u = universe.withColumn("family", family_of(F.col("world_family"))).filter(F.col("family").isNotNull())
    picked = written(select_trades(rows, [threshold], max_hold).filter("executed"), "selection")
    per_run = run_totals(u, picked.drop("threshold"), [])
    units = structure_units(per_run, "run_return", ["family"]).groupBy("family").agg(F.avg("unit").alias("mean_run_net_return_points"))
    seen = rows.join(u.select("run_id", "family"), "run_id")
    wins = picked.join(u.select("run_id", "family"), "run_id").groupBy("family").agg(F.avg("profitable").alias("selected_success_rate"))
    runs = u.groupBy("family").agg(F.count(F.lit(1)).alias("test_runs"))
    n = seen.groupBy("family").agg(F.count(F.lit(1)).alias("test_observations"))
    return runs.join(n, "family", "left").join(units, "family", "left").join(wins, "family", "left").withColumn(
        "test_observations", F.coalesce("test_observations", F.lit(0).cast("long")))


def by_pattern(rows: DataFrame, universe: DataFrame, threshold: float, max_hold: int) -> DataFrame:
    """Portfolio rules re-run inside each pattern family."""
    own = rows.withColumn("source_run", F.col("run_id")).withColumn("run_id", F.concat_ws("|", "pattern_type", "run_id"))
    picked = written(select_trades(own, [threshold], max_hold).filter("executed"), "selection")
    taken = picked.groupBy("pattern_type").agg(
        F.count(F.lit(1)).alias("selected_trades"), F.avg("profitable").alias("selected_success_rate"),
        F.avg("net_directional_return").alias("mean_selected_net_return"))
    base = rows.groupBy("pattern_type").agg(F.count(F.lit(1)).alias("observations"), F.avg("profitable").alias("base_success_rate"))
    totals = picked.groupBy("pattern_type", F.col("source_run").alias("run_id")).agg(F.sum("net_directional_return").alias("_t"))
    struct = universe.select("run_id", "structure_id").join(totals, "run_id")
    # Runs without a trade add zero: the mean over a structure is its sum over all its runs.
    sizes = universe.groupBy("structure_id").agg(F.count(F.lit(1)).alias("_runs"))
    n = universe.agg(F.countDistinct("structure_id")).scalar()
    unit = struct.groupBy("pattern_type", "structure_id").agg(F.sum("_t").alias("_s")).join(sizes, "structure_id")
    mean = unit.groupBy("pattern_type").agg((F.sum(F.col("_s") / F.col("_runs"))).alias("_u"))
    return base.join(taken, "pattern_type", "left").join(mean, "pattern_type", "left").withColumn(
        "mean_run_net_return_points", F.coalesce("_u", F.lit(0.0)) / n).withColumn(
        "selected_trades", F.coalesce("selected_trades", F.lit(0).cast("long"))).drop("_u")


def condition_response(
    rows: DataFrame, features: Sequence[str], *, bins: int = 5, min_all: int = 20, min_one: int = 30, all_label: str = "__all_patterns__"
) -> DataFrame:
    """Outcome by quantile bin of each feature, over all patterns and per pattern.

    Columns are event-weighted means next to means over structures (runs averaged first) with their
    intervals. Scopes with too few rows or fewer than three distinct values are left out.
    """
    long = rows.select(
        "run_id", "structure_id", "profitable", "net_directional_return", "probability",
        F.explode(F.array(F.lit(all_label), F.col("pattern_type"))).alias("pattern_scope"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("x"),
    ).select("*", "x.feature", "x.value").drop("x").filter(F.col("value").isNotNull())
    cell = ["pattern_scope", "feature"]
    need = F.when(F.col("pattern_scope") == all_label, min_all).otherwise(min_one)
    cuts = [i / bins for i in range(bins + 1)]
    edges = long.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("value").alias("_d"))
    edges = edges.filter((F.col("_n") >= need) & (F.col("_d") >= 3)).join(exact_quantiles(long, cell, "value", cuts, "_e"), cell)
    edges = edges.withColumn("_e", F.array_distinct("_e"))
    above = F.size(F.filter("_e", lambda e: e < F.col("value")))
    binned = long.join(edges.select(*cell, "_e"), cell).withColumn("condition_bin", F.greatest(F.lit(1), above))
    key = [*cell, "condition_bin"]
    flat = binned.groupBy(*key, "structure_id", "run_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("sv"), F.sum("profitable").alias("sp"),
        F.sum("net_directional_return").alias("sn"), F.sum("probability").alias("sq"))
    per_run = flat.withColumns({"rp": F.col("sp") / F.col("n"), "rn": F.col("sn") / F.col("n"), "rq": F.col("sq") / F.col("n")})
    unit = per_run.groupBy(*key, "structure_id").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("runs"), F.sum("sv").alias("sv"), F.sum("sp").alias("sp"),
        F.sum("sn").alias("sn"), F.sum("sq").alias("sq"), F.avg("rp").alias("up"), F.avg("rn").alias("un"), F.avg("rq").alias("uq"))
    g = unit.groupBy(*key).agg(
        F.sum("n").alias("observations"), F.sum("runs").alias("runs"), F.count(F.lit(1)).alias("structures"),
        F.sum("sv").alias("sv"), F.sum("sp").alias("sp"), F.sum("sn").alias("sn"), F.sum("sq").alias("sq"),
        F.avg("up").alias("mp"), F.stddev_samp("up").alias("dp"), F.avg("un").alias("mn"), F.stddev_samp("un").alias("dn"), F.avg("uq").alias("mq"))
    n = F.col("observations")
    s, slo, shi = mean_ci(F.col("structures"), F.col("mp"), F.col("dp"))
    r, rlo, rhi = mean_ci(F.col("structures"), F.col("mn"), F.col("dn"))
    return g.select(
        *key, "observations", "runs", "structures", (F.col("sv") / n).alias("mean_feature_value"),
        (F.col("sp") / n).alias("success_rate_event_weighted"), (F.col("sn") / n).alias("net_return_event_weighted"),
        (F.col("sq") / n).alias("probability_event_weighted"), s.alias("mean_run_success_rate"), slo.alias("success_ci_low"),
        shi.alias("success_ci_high"), r.alias("mean_run_net_return"), rlo.alias("net_ci_low"), rhi.alias("net_ci_high"),
        F.col("mq").alias("mean_run_probability"))


def dataset_diagnostics(rows: DataFrame) -> DataFrame:
    """Counts and means by pattern, by family and overall in one pass (grouping sets)."""
    g = rows.groupingSets([["pattern_type"], ["world_family"], []], "pattern_type", "world_family")
    return g.agg(
        F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("observations"),
        F.count_distinct("structure_id").alias("structures"), F.count_distinct("run_id").alias("runs"),
        F.avg("profitable").alias("success_rate"), F.avg("net_directional_return").alias("mean_net_return"))


def run_coverage(universe: DataFrame, rows: DataFrame) -> DataFrame:
    """How many runs of each family hold a pattern at all."""
    have = rows.select("run_id").distinct().withColumn("_has", F.lit(1))
    return universe.join(have, "run_id", "left").groupBy("world_family").agg(
        F.count(F.lit(1)).alias("generated_runs"), F.count_distinct("structure_id").alias("structures"),
        F.count("_has").alias("runs_with_patterns"), (F.count("_has") / F.count(F.lit(1))).alias("pattern_run_fraction"))


def across_runs(summary: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation of each summary column over runs, long form."""
    long = summary.select("run_id", F.explode(F.array(*[
        F.struct(F.lit(c).alias("statistic"), F.col(c).cast("double").alias("value")) for c in columns])).alias("s"))
    return long.groupBy("s.statistic").agg(
        F.count("s.value").alias("runs"), F.avg("s.value").alias("mean"), F.coalesce(F.stddev_pop("s.value"), F.lit(0.0)).alias("sd"))
