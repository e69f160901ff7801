"""Ten geometric matchers and the breakout search as column expressions over pivot blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from candlemill.config import GEOMETRY_FLOOR, PatternConfig
from candlemill.functions.columns import EPS, diffs, median_of
from candlemill.patterns.smoothing import BREAKOUT_LOOKBACK, MAD_SCALE, tail_length

GEOMETRY = (
    "pattern_height", "level_error_ratio", "spacing_bars", "head_prominence_ratio", "shoulder_error_ratio",
    "neckline_slope_height_ratio", "time_asymmetry_ratio", "high_boundary_error_ratio", "low_boundary_error_ratio",
    "boundary_convergence_ratio", "boundary_expansion_ratio", "apex", "upper_slope", "upper_intercept",
    "lower_slope", "lower_intercept",
)


def pivot_blocks(windows: DataFrame, size: int, config: PatternConfig) -> DataFrame:
    """Consecutive pivot blocks p1..pN that lie in the core and end fresh enough."""
    lead = by_core(config, config.context)
    last = lead + F.col("core_length") - 1
    starts = F.when(F.size("pivots") >= size, F.sequence(F.lit(1), F.size("pivots") - (size - 1)))
    blocks = windows.withColumn("_i", F.explode(starts)).withColumns(
        {f"p{k + 1}": F.element_at("pivots", F.col("_i") + k) for k in range(size)})
    start, end = F.col("p1.idx"), F.col(f"p{size}.idx")
    return blocks.filter(
        (start >= lead) & (end <= last) & (last - end <= by_core(config, config.max_age))
        & (end - start + 1 >= config.min_span_bars)
    ).drop("pivots", "_i")


def by_core(config: PatternConfig, value) -> Column:
    """A per-scale setting as a literal lookup on ``core_length``."""
    pairs = [F.lit(x) for c in config.core_lengths for x in (c, int(value(c)))]
    return F.create_map(*pairs)[F.col("core_length")]


def _line(prefix: str, ks: tuple[int, ...]) -> list[dict[str, Column]]:
    """Staged least-squares line through the pivots ``ks``: slope, intercept, bounded R2, RMSE ratio.

    The stages are separate columns so that no sub-expression is written out twice in the plan.
    """
    n, c = len(ks), F.col
    total = lambda terms: sum(terms[1:], terms[0])
    xs, ys = [c(f"x{k}") for k in ks], [c(f"y{k}") for k in ks]
    mx, my, sl, ic = (c(f"{prefix}_{m}") for m in ("mx", "my", "slope", "icpt"))
    bend = F.when(c(f"{prefix}_sst") <= EPS, F.when(c(f"{prefix}_sse") <= EPS, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(
        1.0 - c(f"{prefix}_sse") / c(f"{prefix}_sst"))
    return [
        {f"{prefix}_mx": total(xs) / n, f"{prefix}_my": total(ys) / n},
        {f"{prefix}_slope": total([(u - mx) * (v - my) for u, v in zip(xs, ys)]) / total([(u - mx) * (u - mx) for u in xs])},
        {f"{prefix}_icpt": my - sl * mx},
        {
            f"{prefix}_sse": total([(v - sl * u - ic) * (v - sl * u - ic) for u, v in zip(xs, ys)]),
            f"{prefix}_sst": total([(v - my) * (v - my) for v in ys]),
            f"{prefix}_span": F.greatest(*ys) - F.least(*ys),
        },
        {
            f"{prefix}_r2": F.lit(1.0) if n == 2 else F.least(F.lit(1.0), F.greatest(F.lit(0.0), bend)),
            f"{prefix}_nrmse": F.sqrt(c(f"{prefix}_sse") / n) / F.greatest(c(f"{prefix}_span"), F.lit(EPS)),
        },
    ]


def _stage(df: DataFrame, *stages: dict[str, Column]) -> DataFrame:
    for columns in stages:
        df = df.withColumns(columns)
    return df


def _points(blocks: DataFrame, size: int) -> DataFrame:
    cols = {f"x{k}": F.col(f"p{k}.idx").cast("double") for k in range(1, size + 1)}
    cols |= {f"y{k}": F.col(f"p{k}.value") for k in range(1, size + 1)}
    return blocks.withColumns(cols).withColumns({"high_first": F.col("p1.is_max")}).withColumn(
        "s", F.when(F.col("high_first"), F.lit(1.0)).otherwise(F.lit(-1.0)))


def _shortfall(value: Column, limit: float) -> Column:
    return 1.0 - F.least(F.lit(1.0), value / max(limit, EPS))


def _row(name: Column, direction: Column, rule: str, fit: Column, ok: Column, **geometry) -> Column:
    """NULL unless the match holds; otherwise one candidate struct."""
    fields = [
        name.alias("pattern_name"), direction.alias("expected_direction"), F.lit(rule).alias("rule"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), fit)).alias("geometry_fit_score"),
    ]
    fields += [geometry.get(g, F.lit(None)).cast("double").alias(g) for g in GEOMETRY]
    return F.when(F.coalesce(ok, F.lit(False)), F.struct(*fields))


def _by_phase(high: str, low: str) -> Column:
    return F.when(F.col("high_first"), F.lit(high)).otherwise(F.lit(low))


def shoulder_columns(blocks: DataFrame) -> DataFrame:
    """Head, shoulders and neckline; ``s`` flips an inverse shape so one rule serves both."""
    c = F.col
    clear = lambda k: c("s") * (c(f"y{k}") - (c("neck") * c(f"x{k}") + c("neck0")))
    return _stage(
        blocks,
        {"neck": (c("y4") - c("y2")) / F.greatest(c("x4") - c("x2"), F.lit(1.0))},
        {"neck0": c("y2") - c("neck") * c("x2")},
        {"c1": clear(1), "head": clear(3), "c5": clear(5), "left": c("x3") - c("x1"), "right": c("x5") - c("x3")},
        {"head_ok": F.when(c("head") > EPS, c("head")), "low": F.least("c1", "c5")},
        {
            "head_ratio": (c("head") - 0.5 * (c("c1") + c("c5"))) / c("head_ok"),
            "shoulder_ratio": F.abs(c("c1") - c("c5")) / c("head_ok"),
            "neck_ratio": F.abs(c("y4") - c("y2")) / c("head_ok"),
            "low_ratio": c("low") / c("head_ok"),
            "time_score": F.least(F.lit(1.0), F.exp(-F.abs(F.log(c("left") / c("right"))))),
            "asym": F.greatest("left", "right") / F.least("left", "right"),
        },
    )


def head_and_shoulders(config: PatternConfig) -> Column:
    c = F.col
    ok = (
        (c("s") * c("y3") > c("s") * c("y1")) & (c("s") * c("y3") > c("s") * c("y5"))
        & (c("low_ratio") >= config.min_shoulder_clearance) & (c("head") > F.greatest("c1", "c5"))
        & (c("head_ratio") >= config.min_head_prominence) & (c("shoulder_ratio") <= config.max_shoulder_error)
        & (c("neck_ratio") <= config.max_neckline_slope) & (c("asym") <= config.max_time_asymmetry)
    )
    fit = (
        0.30 * _shortfall(c("shoulder_ratio"), config.max_shoulder_error)
        + 0.18 * _shortfall(c("neck_ratio"), config.max_neckline_slope)
        + 0.24 * F.least(F.lit(1.0), c("head_ratio")) + 0.18 * c("time_score") + 0.10 * F.least(F.lit(1.0), c("low_ratio"))
    )
    return _row(
        _by_phase("head_and_shoulders", "inverse_head_and_shoulders"), _by_phase("bearish", "bullish"), "neckline", fit, ok,
        pattern_height=c("head"), head_prominence_ratio=c("head_ratio"), shoulder_error_ratio=c("shoulder_ratio"),
        neckline_slope_height_ratio=c("neck_ratio"), time_asymmetry_ratio=c("asym"),
        upper_slope=c("neck"), upper_intercept=c("neck0"), lower_slope=c("neck"), lower_intercept=c("neck0"))


def channel_columns(blocks: DataFrame) -> DataFrame:
    """Upper and lower boundary of a five-pivot channel, whichever side it starts on."""
    c = F.col
    odd, even = _line("odd", (1, 3, 5)), _line("even", (2, 4))
    pick = lambda a, b: F.when(c("high_first"), c(a)).otherwise(c(b))
    ys = [f"y{k}" for k in range(1, 6)]
    return _stage(
        blocks, *[u | v for u, v in zip(odd, even)],
        {"us": pick("odd_slope", "even_slope"), "ui": pick("odd_icpt", "even_icpt"),
         "ls": pick("even_slope", "odd_slope"), "li": pick("even_icpt", "odd_icpt")},
        {
            "w0": (c("us") * c("x2") + c("ui")) - (c("ls") * c("x2") + c("li")),
            "w1": (c("us") * c("x4") + c("ui")) - (c("ls") * c("x4") + c("li")),
            "full": F.greatest(*ys) - F.least(*ys),
            "residual": F.least(F.lit(1.0), 0.5 * c("odd_nrmse") + 0.5 * c("even_nrmse")),
            "gap": F.when(F.abs(c("us") - c("ls")) > EPS, c("us") - c("ls")),
            "span": F.greatest(F.lit(1.0), c("x5") - c("x1")),
            "top": pick("odd_my", "even_my"), "bottom": pick("even_my", "odd_my"),
            "top_scatter": pick("odd_span", "even_span"), "bottom_scatter": pick("even_span", "odd_span"),
        },
        {"w0_ok": F.when(c("w0") > EPS, c("w0")), "apex_x": (c("li") - c("ui")) / c("gap"),
         "level": F.when(c("top") - c("bottom") > EPS, c("top") - c("bottom"))},
        {"growth": c("w1") / c("w0_ok") - 1.0, "shrink": 1.0 - c("w1") / c("w0_ok"),
         "far": (c("apex_x") - c("x4")) / c("span"),
         "hi_err": c("top_scatter") / c("level"), "lo_err": c("bottom_scatter") / c("level")},
    )


def _lines() -> dict[str, Column]:
    c = F.col
    return {"upper_slope": c("us"), "upper_intercept": c("ui"), "lower_slope": c("ls"), "lower_intercept": c("li")}


def broadening(config: PatternConfig) -> Column:
    c = F.col
    ok = (c("us") > 0) & (c("ls") < 0) & (c("w1") > c("w0")) & (c("growth") >= config.min_broadening_expansion)
    score = F.least(F.lit(1.0), c("growth") / max(config.min_broadening_expansion * 3.0, EPS))
    fit = 0.30 * c("odd_r2") + 0.30 * c("even_r2") + 0.30 * score + 0.10 * (1.0 - c("residual"))
    return _row(F.lit("broadening_formation"), F.lit("neutral"), "expanding", fit, ok,
                pattern_height=c("full"), boundary_expansion_ratio=c("growth"), **_lines())


def triangle(config: PatternConfig) -> Column:
    c = F.col
    ok = (
        (c("us") < 0) & (c("ls") > 0) & (c("w1") > 0) & (c("w1") < c("w0_ok")) & (c("shrink") >= config.min_triangle_convergence)
        & (c("apex_x") > c("x4")) & (c("apex_x") - c("x4") <= config.max_triangle_apex_spans * c("span"))
    )
    fit = (
        0.35 * (0.5 * c("odd_r2") + 0.5 * c("even_r2"))
        + 0.35 * F.least(F.lit(1.0), c("shrink") / max(config.min_triangle_convergence * 3.0, EPS))
        + 0.20 * F.greatest(F.lit(0.0), 1.0 - c("far") / max(config.max_triangle_apex_spans, EPS))
        + 0.10 * (1.0 - c("residual"))
    )
    return _row(F.lit("symmetrical_triangle"), F.lit("neutral"), "converging", fit, ok,
                pattern_height=c("full"), boundary_convergence_ratio=c("shrink"), apex=c("apex_x"), **_lines())


def rectangle(config: PatternConfig) -> Column:
    c, zero = F.col, F.lit(0.0)
    ok = (c("hi_err") <= config.max_rectangle_error) & (c("lo_err") <= config.max_rectangle_error)
    fit = 0.5 * _shortfall(c("hi_err"), config.max_rectangle_error) + 0.5 * _shortfall(c("lo_err"), config.max_rectangle_error)
    return _row(F.lit("rectangle"), F.lit("neutral"), "horizontal", fit, ok, pattern_height=c("level"),
                high_boundary_error_ratio=c("hi_err"), low_boundary_error_ratio=c("lo_err"),
                upper_slope=zero, upper_intercept=c("top"), lower_slope=zero, lower_intercept=c("bottom"))


def double_columns(blocks: DataFrame, config: PatternConfig) -> DataFrame:
    c = F.col
    near, far = (by_core(config, lambda k, i=i: config.double_spacing(k)[i]).cast("double") for i in (0, 1))
    return _stage(
        blocks,
        {"near": near, "far": far, "gap": c("x3") - c("x1"),
         "swing": F.least(c("s") * c("y1"), c("s") * c("y3")) - c("s") * c("y2")},
        {"level_err": F.abs(c("y1") - c("y3")) / F.when(c("swing") > EPS, c("swing")),
         "z": (c("gap") - 0.5 * (c("near") + c("far"))) / F.greatest(F.lit(1.0), 0.5 * (c("far") - c("near")))},
    )


def double_extreme(config: PatternConfig) -> Column:
    c, zero = F.col, F.lit(0.0)
    ok = (c("gap") >= c("near")) & (c("gap") <= c("far")) & (c("level_err") <= config.max_double_level_error)
    fit = 0.80 * _shortfall(c("level_err"), config.max_double_level_error) + 0.20 * F.exp(-0.5 * c("z") * c("z"))
    return _row(_by_phase("double_top", "double_bottom"), _by_phase("bearish", "bullish"), "neckline", fit, ok,
                pattern_height=c("swing"), level_error_ratio=c("level_err"), spacing_bars=c("gap"),
                upper_slope=zero, upper_intercept=c("y2"), lower_slope=zero, lower_intercept=c("y2"))


def _exploded(blocks: DataFrame, size: int, matches: list[Column]) -> DataFrame:
    pivots = F.array(*[F.col(f"p{k}") for k in range(1, size + 1)])
    keep = ["run_id", "core_length", "window_end", "noise", "tail"]
    return blocks.select(*keep, pivots.alias("block"), F.explode(F.array_compact(F.array(*matches))).alias("m")).select(
        *keep, "block", "m.*")


def match_blocks(five: DataFrame, three: DataFrame, config: PatternConfig = PatternConfig()) -> DataFrame:
    """All families over prepared five- and three-pivot blocks, then the height-to-noise filter."""
    wide = channel_columns(shoulder_columns(_points(five, 5)))
    big = _exploded(wide, 5, [head_and_shoulders(config), broadening(config), rectangle(config), triangle(config)])
    small = _exploded(double_columns(_points(three, 3), config), 3, [double_extreme(config)])
    threshold = F.greatest(F.lit(GEOMETRY_FLOOR), config.height_noise_scale * F.col("noise"))
    return big.unionByName(small).withColumn("pattern_height_threshold", threshold).filter(
        F.col("pattern_height") >= F.col("pattern_height_threshold"))


def match_patterns(windows: DataFrame, config: PatternConfig = PatternConfig()) -> DataFrame:
    return match_blocks(pivot_blocks(windows, 5, config), pivot_blocks(windows, 3, config), config)


def find_breakouts(candidates: DataFrame, config: PatternConfig = PatternConfig()) -> DataFrame:
    """First bar after the shape, known by availability, whose close leaves its boundary.

    Only the stored tail is searched. A converging channel stops at its apex or when its lines have
    crossed; an expanding one skips crossed bars; necklines break only in the expected direction.
    """
    length = by_core(config, config.observation_length)
    tails = by_core(config, lambda c: tail_length(config, c))
    first = (F.element_at("block", -1)["idx"] + 1).cast("int")
    offset = length - tails
    upper = lambda t: F.col("upper_slope") * t + F.col("upper_intercept")
    lower = lambda t: F.col("lower_slope") * t + F.col("lower_intercept")
    value = lambda t: F.get("tail", (t - offset).cast("int"))

    def state(t: Column) -> Column:
        v, hi, lo = value(t), upper(t), lower(t)
        neck = F.when((F.col("expected_direction") == "bearish") & (v < lo), F.lit(-1)).when(
            (F.col("expected_direction") == "bullish") & (v > hi), F.lit(1)).otherwise(F.lit(0))
        free = F.when(v > hi, F.lit(1)).when(v < lo, F.lit(-1)).otherwise(F.lit(0))
        crossed = hi <= lo
        return (
            F.when(F.col("rule") == "neckline", neck)
            .when(F.col("rule") == "horizontal", free)
            .when(F.col("rule") == "expanding", F.when(crossed, F.lit(0)).otherwise(free))
            .otherwise(F.when(crossed | (t + 1e-9 >= F.col("apex")), F.lit(2)).otherwise(free))
        )

    steps = F.when(first < length, F.sequence(first, length - 1)).otherwise(F.array().cast("array<int>"))
    events = F.filter(
        F.transform(steps, lambda t: F.struct(t.alias("t"), state(t.cast("double")).alias("s"))), lambda e: e["s"] != 0)
    t, c = F.col("_t"), F.col
    from_t = F.greatest(F.lit(0), t - BREAKOUT_LOOKBACK)
    change = diffs(c("_recent"))
    out = _stage(
        candidates,
        {"_hit": F.get(events, F.lit(0))},
        {"_t": F.when(c("_hit.s") != 2, c("_hit.t")), "_up": c("_hit.s") == 1},
        {"breakout_confirmed": t.isNotNull(),
         "breakout_index": c("window_end") - length + 1 + t,
         "breakout_level": F.when(t.isNotNull(), F.when(c("_up"), upper(t)).otherwise(lower(t))),
         "_recent": F.slice("tail", (from_t - offset + 1).cast("int"), (t - from_t + 1).cast("int"))},
        {"breakout_direction": F.when(c("breakout_confirmed"), F.when(c("_up"), "bullish").otherwise("bearish")),
         "_away": F.abs(F.get("tail", (t - offset).cast("int")) - c("breakout_level")), "_d": change},
        {"_centre": median_of(c("_d"))},
        {"_sigma": F.when(F.size("_recent") >= 3, MAD_SCALE * median_of(F.transform("_d", lambda v: F.abs(v - c("_centre"))))).otherwise(F.lit(0.0))},
        {"breakout_strength_height": c("_away") / F.greatest(c("pattern_height"), F.lit(EPS)),
         "breakout_strength_volatility": c("_away") / F.when(c("_sigma") > EPS, c("_sigma"))},
    )
    if config.require_double_confirmation:
        out = out.filter(~c("pattern_name").isin("double_top", "double_bottom") | c("breakout_confirmed"))
    return out.drop("_hit", "_t", "_up", "_recent", "_away", "_d", "_centre", "_sigma", "tail")
