"""The detector: bars in, candidates, events and clusters out (all DataFrames)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from candlemill.config import NEUTRAL_PATTERNS, PatternConfig, settings_hash
from candlemill.functions.columns import diffs, divide, ln, median_of
from candlemill.operators.controls import price_prefixes
from candlemill.operators.features import relative_log_price
from candlemill.patterns.matchers import by_core, find_breakouts, match_patterns
from candlemill.patterns.smoothing import MAD_SCALE, pivot_windows
from candlemill.sources.series import number_series, written

DETECTOR_RULES = {
    "geometry": "smoothed relative log price", "breakout": "close, known by availability",
    "execution": "decide after the available bar closes, fill after the configured delay",
    "clustering": "causal, against the immutable first member",
}


@dataclass(frozen=True)
class Detection:
    candidates: DataFrame
    events: DataFrame
    clusters: DataFrame


def warmup(spark, config: PatternConfig = PatternConfig()) -> DataFrame:
    """Bars each scale needs before its first window, and the warm-up of all scales together."""
    rows = [(c, config.observation_length(c), config.context(c), config.max_age(c), config.warmup_bars) for c in config.core_lengths]
    return spark.createDataFrame(rows, "core_length int, observation_length int, context_bars int, max_age_bars int, full_warmup_bars int")


def public_candidates(matched: DataFrame, config: PatternConfig = PatternConfig()) -> DataFrame:
    """Global coordinates, availability, execution index and identity of each candidate."""
    length = by_core(config, config.observation_length)
    context = by_core(config, config.context)
    origin = F.col("window_end") - length + 1
    out = matched.withColumn("window_start", origin)
    start, end = F.get("block", F.lit(0))["idx"], F.element_at("block", -1)["idx"]
    out = out.withColumns({
        "start_index": F.col("window_start") + start,
        "end_index": F.col("window_start") + end,
        "available_at_index": F.col("window_end"),
        "entry_index": F.col("window_end") + config.execution_delay,
        "observation_window_length": length,
        "core_window_length": F.col("core_length"),
        "core_start_index": F.col("window_start") + context,
        "core_end_index": F.col("window_start") + context + F.col("core_length") - 1,
        "pivot_indices": F.transform("block", lambda p: F.col("window_start") + p["idx"]),
        "pivot_close_refined": F.transform("block", lambda p: F.col("window_start") + p["raw_idx"]),
        "pivot_kinds": F.transform("block", lambda p: F.when(p["is_max"], "max").otherwise("min")),
        "pivot_values": F.transform("block", lambda p: p["value"]),
        "phase_start": F.when(F.get("block", F.lit(0))["is_max"], "high").otherwise("low"),
    })
    out = out.withColumns({
        "pattern_span_bars": F.col("end_index") - F.col("start_index") + 1,
        "pattern_age_at_availability_bars": F.col("available_at_index") - F.col("end_index"),
        "pattern_age_at_core_end_bars": F.col("core_end_index") - F.col("end_index"),
        # Lines and apex in global bar coordinates.
        "upper_intercept_global": F.col("upper_intercept") - F.col("upper_slope") * F.col("window_start"),
        "lower_intercept_global": F.col("lower_intercept") - F.col("lower_slope") * F.col("window_start"),
        "apex_global": F.col("apex") + F.col("window_start"),
        "config_hash": F.lit(settings_hash(config, DETECTOR_RULES)),
        "bandwidth": F.create_map(*[
            F.lit(v) for c in config.core_lengths
            for v in (c, float(sorted(config.bandwidths(c))[len(config.bandwidths(c)) // 2]))])[F.col("core_length")],
    })
    key = F.struct("run_id", "core_length", "window_end", "pattern_name", "start_index")
    return out.withColumn("candidate_id", F.concat(F.lit("C-"), F.substring(F.sha2(F.to_json(key), 256), 1, 20))).drop("block")


def event_identity(candidates: DataFrame, bars: DataFrame) -> DataFrame:
    """Causal id: pattern, coordinates, pivots, settings and the price prefix up to availability."""
    prefix = price_prefixes(bars).withColumnRenamed("bar_index", "available_at_index")
    known = candidates.join(prefix, ["run_id", "available_at_index"])
    payload = F.to_json(F.struct(
        "available_at_index", "config_hash", "end_index", "pattern_name", "pivot_indices", "pivot_kinds", "prefix",
        "run_id", "start_index"))
    return known.withColumn("own_event_id", F.concat(F.lit("EV-"), F.substring(F.sha2(payload, 256), 1, 18)))


def refine_pivots(candidates: DataFrame, bars: DataFrame, config: PatternConfig = PatternConfig()) -> DataFrame:
    """Wick-refined pivots: highest high or lowest low within the radius, inside the pattern."""
    r = config.pivot_refine_radius
    p = candidates.select(
        "run_id", "candidate_id", "start_index", "end_index", F.posexplode(F.arrays_zip("pivot_indices", "pivot_kinds")).alias("_k", "_p"))
    near = p.select(
        "run_id", "candidate_id", "_k", F.col("_p.pivot_kinds").alias("_kind"),
        F.explode(F.sequence(F.greatest("start_index", F.col("_p.pivot_indices") - r),
                             F.least("end_index", F.col("_p.pivot_indices") + r))).alias("bar_index"))
    j = near.join(bars.select("run_id", "bar_index", "high", "low", "close"), ["run_id", "bar_index"])
    score = F.when(F.col("_kind") == "max", F.col("high")).otherwise(-F.col("low"))
    one = j.groupBy("run_id", "candidate_id", "_k").agg(
        F.max_by(F.struct("bar_index", F.when(F.col("_kind") == "max", F.col("high")).otherwise(F.col("low")).alias("price"), "close"),
                 F.struct(score.alias("s"), (-F.col("bar_index")).alias("b"))).alias("_b"))
    back = one.groupBy("run_id", "candidate_id").agg(F.sort_array(F.collect_list(F.struct("_k", "_b"))).alias("_r"))
    return candidates.join(back, ["run_id", "candidate_id"]).withColumns({
        "pivot_wick_refined": F.transform("_r", lambda x: x["_b"]["bar_index"]),
        "pivot_wick_prices": F.transform("_r", lambda x: x["_b"]["price"]),
        "pivot_wick_closes": F.transform("_r", lambda x: x["_b"]["close"]),
    }).drop("_r")


def _std(d: str) -> Column:
    mean = F.aggregate(d, F.lit(0.0), lambda a, v: a + v) / F.size(d)
    square = F.aggregate(F.transform(d, lambda v: v * v), F.lit(0.0), lambda a, v: a + v) / F.size(d)
    return F.when(F.size(d) >= 2, F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))).otherwise(F.lit(0.0))


def _robust(d: str, centre: str) -> Column:
    mad = median_of(F.transform(d, lambda v: F.abs(v - F.col(centre))))
    return F.when(F.size(d) >= 2, MAD_SCALE * mad).otherwise(F.lit(0.0))


def context_features(candidates: DataFrame, bars: DataFrame, config: PatternConfig = PatternConfig()) -> DataFrame:
    """What the market did over the pattern and over the bars just before it."""
    lo = F.greatest(F.lit(0), F.col("start_index") - config.context_lookback)
    span = candidates.select("run_id", "candidate_id", "start_index", F.explode(F.sequence(lo, F.col("end_index"))).alias("bar_index"))
    rel = relative_log_price(bars).select("run_id", "bar_index", "rel_log", "volume", ln(divide(F.col("high"), F.col("low"))).alias("_range"))
    j = span.join(rel, ["run_id", "bar_index"]).withColumn("_pre", F.col("bar_index") < F.col("start_index"))
    pre, inside = F.col("_pre"), ~F.col("_pre")
    point = F.struct("bar_index", "rel_log")
    g = j.groupBy("run_id", "candidate_id").agg(
        F.transform(F.sort_array(F.collect_list(F.when(pre, point))), lambda v: v["rel_log"]).alias("_a"),
        F.transform(F.sort_array(F.collect_list(F.when(inside, point))), lambda v: v["rel_log"]).alias("_b"),
        F.covar_pop(F.when(pre, F.col("bar_index").cast("double")), F.when(pre, F.col("rel_log"))).alias("_cov"),
        F.var_pop(F.when(pre, F.col("bar_index").cast("double"))).alias("_var"),
        F.avg(F.when(pre, F.col("volume"))).alias("pre_pattern_mean_volume"),
        F.avg(F.when(inside, F.col("volume"))).alias("pattern_mean_volume"),
        F.avg(F.when(inside, F.col("_range"))).alias("pattern_mean_log_high_low_range"))
    g = g.withColumns({"_da": diffs(F.col("_a")), "_db": diffs(F.col("_b"))})
    g = g.withColumns({"_ma": median_of(F.col("_da")), "_mb": median_of(F.col("_db"))})
    two = F.size("_a") >= 2
    vr = F.when(F.col("pre_pattern_mean_volume") > 0, F.col("pattern_mean_volume") / F.col("pre_pattern_mean_volume"))
    f = g.select(
        "run_id", "candidate_id", "pre_pattern_mean_volume", "pattern_mean_volume", "pattern_mean_log_high_low_range",
        F.size("_a").alias("context_bar_count"),
        F.when(two, F.element_at("_a", -1) - F.get("_a", F.lit(0))).otherwise(F.lit(0.0)).alias("pre_pattern_log_return"),
        F.when(two, F.try_divide(F.col("_cov"), F.col("_var"))).otherwise(F.lit(0.0)).alias("pre_pattern_trend_slope"),
        _std("_da").alias("pre_pattern_log_volatility"), _robust("_da", "_ma").alias("pre_pattern_robust_log_volatility"),
        _std("_db").alias("pattern_log_volatility"), _robust("_db", "_mb").alias("pattern_robust_log_volatility"),
        vr.alias("pattern_to_pre_volume_ratio"),
        F.when(vr > 0, F.log(vr)).alias("pattern_to_pre_log_volume_ratio"))
    return candidates.join(f, ["run_id", "candidate_id"])


# --- similarity and clustering ---------------------------------------------------------------


def interval_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared bars over the shorter span, both ends included."""
    shared = F.least(e1, e2) - F.greatest(s1, s2) + 1
    shorter = F.least(e1 - s1, e2 - s2) + 1
    return F.when(shared > 0, shared / shorter).otherwise(F.lit(0.0))


def placed_agreement(a: Column, b: Column, kinds_a: Column, kinds_b: Column, tolerance: int) -> Column:
    """Share of pivots at the same place, for two shapes of equal kinds; 0 for shapes of other kinds."""
    near = F.filter(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= tolerance), lambda hit: hit)
    return F.when(kinds_a == kinds_b, F.size(near) / F.size(a)).otherwise(F.lit(0.0))


def ordered_agreement(a: Column, b: Column, kinds_a: Column, kinds_b: Column, tolerance: int) -> Column:
    """Longest run of pivots, in order but with gaps, that two shapes share, over the shorter shape's pivots.

    The rows of the table of common subsequences are folded one into the next, each entry from its three neighbours.
    """
    mine, theirs = (F.zip_with(p, k, lambda x, y: F.struct(x.alias("at"), y.alias("kind"))) for p, k in ((a, kinds_a), (b, kinds_b)))

    def next_row(above: Column, x: Column) -> Column:
        def entry(row: Column, j: Column) -> Column:
            y = F.get(theirs, j - 1)
            met = (x["kind"] == y["kind"]) & (F.abs(x["at"] - y["at"]) <= tolerance)
            return F.array_append(row, F.when(met, F.get(above, j - 1) + 1).otherwise(F.greatest(F.get(above, j), F.get(row, j - 1))))

        return F.aggregate(F.sequence(F.lit(1), F.size(theirs)), F.array(F.lit(0)), entry)

    table = F.aggregate(mine, F.array_repeat(F.lit(0), F.size(theirs) + 1), next_row)
    return F.element_at(table, -1) / F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))


# Weights of the three parts of a similarity.
SIMILARITY_WEIGHTS = {"overlap": 0.45, "pivots": 0.45, "centre": 0.10}


def pair_parts(pairs: DataFrame, config: PatternConfig) -> DataFrame:
    """Columns ``overlap``, ``pivots``, ``centre`` and ``similarity`` of rows with two shapes ``a`` and ``b`` of one family.

    A pair below the least overlap or pivot agreement of its family has no similarity (null).
    """
    a, b, weights = F.col("a"), F.col("b"), SIMILARITY_WEIGHTS
    neutral = F.col("pattern_name").isin(*NEUTRAL_PATTERNS)
    args = (a["pivot_indices"], b["pivot_indices"], a["pivot_kinds"], b["pivot_kinds"], config.cluster_pivot_tolerance)
    span = F.greatest(F.least(a["end_index"] - a["start_index"], b["end_index"] - b["start_index"]), F.lit(1))
    middles = F.abs((a["start_index"] - b["start_index"]) + (a["end_index"] - b["end_index"])) / 2
    measured = pairs.withColumn("overlap", interval_overlap(a["start_index"], a["end_index"], b["start_index"], b["end_index"])).withColumns({
        # the table is folded only for pairs that overlap enough
        "pivots": F.when(F.col("overlap") >= config.cluster_min_overlap, F.when(neutral, ordered_agreement(*args)).otherwise(placed_agreement(*args))),
        "centre": F.greatest(F.lit(0.0), 1 - middles / F.greatest(config.cluster_center_tolerance * span, F.lit(1.0)))})
    least = F.when(neutral, config.cluster_min_pivot_match_neutral).otherwise(config.cluster_min_pivot_match)
    total = sum((w * F.col(part) for part, w in weights.items()), F.lit(0.0))
    return measured.withColumn("similarity", F.when(F.col("pivots") >= least, total))


ORDER = ["available_at_index", "neg_fit", "start_index", "end_index", "core_length", "candidate_id"]
SHAPE = ["start_index", "end_index", "pivot_indices", "pivot_kinds"]


def causal_links(ranked: DataFrame, config: PatternConfig, *, bucket: int = 128) -> DataFrame:
    """Similar pairs of a family: ``g``, ``step`` and the earlier ``other`` still in reach, with their ``similarity``.

    ``ranked`` numbers the candidates of each group ``g`` (run and family) in causal order. Shapes meet in buckets of bars, and a
    pair counts in the bucket of its first shared bar only, so the work grows with the shapes that overlap.
    """
    cover = F.explode(F.sequence(F.floor(F.col("start_index") / bucket), F.floor(F.col("end_index") / bucket))).alias("_b")
    shape = F.struct(*SHAPE)
    me = ranked.select("g", "step", "available_at_index", shape.alias("b"), cover)
    other = ranked.select("g", F.col("step").alias("other"), shape.alias("a"), cover)
    met = me.join(other, ["g", "_b"]).filter(
        (F.col("other") < F.col("step")) & (F.col("a.end_index") >= F.col("b.start_index"))
        & (F.col("a.end_index") >= F.col("available_at_index") - config.warmup_bars)
        & (F.col("_b") == F.floor(F.greatest(F.col("a.start_index"), F.col("b.start_index")) / bucket)))
    return pair_parts(met.withColumn("pattern_name", F.col("g.pattern_name")), config).filter("similarity > 0").select("g", "step", "other", "similarity")


def first_members(ranked: DataFrame, links: DataFrame, *, chunk: int = 2048) -> DataFrame:
    """``g``, ``step`` of the first members: candidates without a link to an earlier first member.

    The rule is sequential, but short of memory: what a chunk of candidates decides depends on the first members just before it
    only. All chunks decide at once as if nothing came before; a chunk whose predecessors then turn out to hold first members
    it is linked with, or no longer does, decides again, until nothing changes. After round r at least the first r chunks of every
    group are final, so the result is that of the walk in order. A chunk is folded in the JVM.
    """
    number = lambda c: F.floor(F.col(c) / chunk).cast("long")
    back = links.groupBy("g", "step").agg(F.collect_list("other").alias("back"))
    none = F.array().cast("array<bigint>")
    rows = ranked.select("g", "step").join(back, ["g", "step"], "left").select("g", "step", F.coalesce("back", none).alias("back"), number("step").alias("chunk"))
    rows = written(rows.groupBy("g", "chunk").agg(F.sort_array(F.collect_list(F.struct("step", "back"))).alias("rows")), "walk")
    outside = written(links.select("g", number("step").alias("chunk"), "other").filter(number("other") < F.col("chunk")).distinct(), "walk-outside")

    def decide(todo: DataFrame) -> DataFrame:
        fold = lambda held, r: F.when(F.arrays_overlap(held, r["back"]), held).otherwise(F.array_append(held, r["step"]))
        held = F.aggregate("rows", F.col("before"), fold)
        return todo.select("g", "chunk", "before", F.filter(held, lambda x: x >= F.col("chunk") * chunk).alias("firsts"))

    now = written(decide(rows.withColumn("before", none)), "walk-decided")
    while True:
        firsts = now.select("g", F.explode("firsts").alias("other"))
        seen = outside.join(firsts, ["g", "other"]).groupBy("g", "chunk").agg(F.sort_array(F.collect_list("other")).alias("seen"))
        state = now.join(seen, ["g", "chunk"], "left").withColumn("seen", F.coalesce("seen", none))
        changed = written(state.filter("seen != before").select("g", "chunk", F.col("seen").alias("before")), "walk-changed")
        if not changed.head(1):
            return firsts.withColumnRenamed("other", "step")
        again = decide(rows.join(changed, ["g", "chunk"]))
        now = written(now.join(changed, ["g", "chunk"], "left_anti").unionByName(again), "walk-decided")


def cluster_candidates(candidates: DataFrame, config: PatternConfig = PatternConfig()) -> DataFrame:
    """Causal event membership of every candidate (needs ``own_event_id``).

    In causal order each candidate joins the most similar first member in reach (ties: the earliest), or opens a new event.
    """
    slim = candidates.select(
        F.struct("run_id", "pattern_name").alias("g"), "candidate_id", "own_event_id", (-F.col("geometry_fit_score")).alias("neg_fit"), "core_length", "available_at_index", *SHAPE)
    ranked = written(number_series(slim, "g", ORDER), "ranked")
    links = written(causal_links(ranked, config), "links")
    firsts = first_members(ranked, links)
    own = ranked.select("g", "step", "candidate_id", "own_event_id", F.col("pivot_kinds").alias("kinds"))
    anchors = own.join(firsts, ["g", "step"], "left_semi").select("g", F.col("step").alias("other"), F.col("own_event_id").alias("event_id"), F.col("kinds").alias("first_kinds"))
    best = links.join(anchors, ["g", "other"]).groupBy("g", "step").agg(
        F.max_by(F.struct("event_id", "similarity", "first_kinds"), F.struct("similarity", (-F.col("other")).alias("early"))).alias("best"))
    out = own.join(best, ["g", "step"], "left")
    moved = F.col("g.pattern_name").isin(*NEUTRAL_PATTERNS) & (F.col("best.first_kinds") != F.col("kinds"))
    relation = F.when(F.col("best").isNull(), "primary").when(moved, "phase_shift_extension").otherwise("same_structure_view")
    out = out.select(F.col("g.run_id").alias("run_id"), "candidate_id", F.coalesce("best.event_id", "own_event_id").alias("event_id"), F.col("best").isNull().alias("is_primary"),
                     F.col("best.similarity").alias("anchor_similarity"), relation.alias("relation"))
    return candidates.join(out, ["run_id", "candidate_id"])


def competition(members: DataFrame, config: PatternConfig = PatternConfig(), *, bucket: int = 128) -> DataFrame:
    """Other families' first members known by a member's own availability and overlapping it.

    Intervals meet in bar buckets; the pair is kept in the bucket of its first shared bar only.
    """
    cover = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bucket), F.floor(F.col(e) / bucket)))
    me = members.select("run_id", "candidate_id", "event_id", "pattern_name", "start_index", "end_index", "available_at_index",
                        cover("start_index", "end_index").alias("_b"))
    other = members.filter("is_primary").select(
        "run_id", F.col("event_id").alias("o_event"), F.col("pattern_name").alias("o_name"), F.col("start_index").alias("o_start"),
        F.col("end_index").alias("o_end"), F.col("available_at_index").alias("o_known"), cover("start_index", "end_index").alias("_b"))
    pair = me.join(other, ["run_id", "_b"]).filter(
        (F.col("o_name") != F.col("pattern_name")) & (F.col("o_event") != F.col("event_id"))
        & (F.col("o_known") <= F.col("available_at_index"))
        & (F.col("_b") == F.floor(F.greatest("start_index", "o_start") / bucket))
        & (interval_overlap(F.col("start_index"), F.col("end_index"), F.col("o_start"), F.col("o_end")) >= config.competition_overlap))
    seen = pair.groupBy("run_id", "candidate_id").agg(
        F.sort_array(F.collect_set("o_event")).alias("competing_event_ids"),
        F.sort_array(F.collect_set("o_name")).alias("competing_patterns"))
    empty = F.array().cast("array<string>")
    return members.join(seen, ["run_id", "candidate_id"], "left").withColumns({
        "competing_pattern": F.col("competing_event_ids").isNotNull(),
        "competing_event_ids": F.coalesce("competing_event_ids", empty),
        "competing_patterns": F.coalesce("competing_patterns", empty),
    })


def cluster_summary(members: DataFrame) -> DataFrame:
    return members.groupBy("run_id", "event_id", "pattern_name").agg(
        F.count(F.lit(1)).alias("members"),
        F.sort_array(F.collect_set("core_length")).alias("supporting_core_windows"),
        F.min("available_at_index").alias("first_available_at_index"),
        F.max("available_at_index").alias("last_available_at_index"),
        F.max(F.col("breakout_confirmed").cast("int")).cast("boolean").alias("ever_confirmed"))


def confirmed_events(members: DataFrame) -> DataFrame:
    """Earliest confirmed member of each event: its own availability, the event's id."""
    w = Window.partitionBy("run_id", "event_id").orderBy(
        "available_at_index", "entry_index", "start_index", "end_index", F.desc("geometry_fit_score"), "candidate_id")
    return members.filter("breakout_confirmed").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def raw_candidates(bars: DataFrame, config: PatternConfig = PatternConfig()) -> DataFrame:
    """Every fresh pattern view of every scale with its breakout, before any clustering."""
    windows = written(pivot_windows(bars, config), "windows")
    matched = written(match_patterns(windows, config), "matched")
    return public_candidates(find_breakouts(matched, config), config)


def detect(bars: DataFrame, config: PatternConfig = PatternConfig(), *, context: bool = True) -> Detection:
    """Full universe: annotated candidates, first members (events) and cluster summaries."""
    found = written(event_identity(raw_candidates(bars, config), bars), "identified")
    if context:
        found = context_features(refine_pivots(found, bars, config), bars, config)
        found = written(found, "candidates")
    members = written(competition(cluster_candidates(found, config), config), "members")
    return Detection(members, members.filter("is_primary"), cluster_summary(members))


def event_listing(events: DataFrame) -> DataFrame:
    """One readable line per event, in the order a trader would have seen them."""
    line = F.format_string("%s [%d-%d] known at bar %d, fit %.3f, breakout %s", "pattern_name", "start_index", "end_index",
                           "available_at_index", "geometry_fit_score", F.coalesce("breakout_direction", F.lit("none")))
    return events.select("run_id", "available_at_index", "event_id", line.alias("line")).orderBy("run_id", "available_at_index", "event_id")
