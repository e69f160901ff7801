"""Control entries: the unconditional population and state-matched nulls.

The matched pool of a trade is a nearest-neighbour search in (volatility, spread) over all other
entries of its run, through a packed tree of boxes (``neighbours``): no trade is paired with a whole run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from candlemill.config import CostModel, PatternConfig, ProcedureConfig
from candlemill.functions.columns import EPS
from candlemill.functions.windows import bucketed_scan, over_halo
from candlemill.operators.neighbours import nearest_points
from candlemill.operators.trades import exit_outcomes, looked_up, round_trip
from candlemill.sources.series import sorted_join, written

POOL = ["run_id", "horizon", "min_entry"]


def minimum_entry(observation: Column, delay: Column | int = 1) -> Column:
    delay = F.lit(delay) if isinstance(delay, int) else delay
    return F.greatest(F.lit(1), observation - 1 + delay).cast("long")


def minimum_entries(config: PatternConfig) -> list[int]:
    return sorted({max(1, config.observation_length(c) - 1 + config.execution_delay) for c in config.core_lengths})


def eligible_entries(bars: DataFrame, bars_per_run: DataFrame, horizons: Sequence[int], minimums: Sequence[int]) -> DataFrame:
    """Every bar that may be entered, per horizon and warm-up."""
    return _planned(sorted_join(bars, bars_per_run.select("run_id", "n_bars"), "run_id"), "n_bars", horizons, minimums)


def _planned(bars: DataFrame, end: str, horizons: Sequence[int], minimums: Sequence[int]) -> DataFrame:
    plan = F.explode(F.array(*[
        F.struct(F.lit(int(h)).alias("horizon"), F.lit(int(m)).cast("long").alias("min_entry"))
        for h in horizons for m in minimums]))
    return (
        bars.withColumn("_p", plan)
        .select("*", "_p.horizon", "_p.min_entry")
        .filter((F.col("bar_index") >= F.col("min_entry")) & (F.col("bar_index") <= F.col(end) - F.col("horizon")))
        .withColumnRenamed("bar_index", "entry_index")
        .drop("_p", end)
    )


def unconditional(outcomes: DataFrame, minimums: Sequence[int]) -> DataFrame:
    """Mean net return and hit rate of all eligible entries, one pass with map-side combine."""
    aggs = []
    for m in minimums:
        inside = F.col("entry_index") >= m
        aggs += [
            F.avg(F.when(inside, F.col("net_return"))).alias(f"_m{m}"),
            F.avg(F.when(inside, (F.col("gross_return") > 0).cast("double"))).alias(f"_h{m}"),
            F.count(F.when(inside, 1)).alias(f"_n{m}"),
        ]
    wide = outcomes.groupBy("run_id", "horizon", "direction").agg(*aggs)
    long = F.explode(F.array(*[
        F.struct(F.lit(int(m)).cast("long").alias("min_entry"), F.col(f"_n{m}").alias("eligible"),
                 F.col(f"_m{m}").alias("mean_net"), F.col(f"_h{m}").alias("hit_rate")) for m in minimums]))
    return wide.select("run_id", "horizon", "direction", long.alias("u")).select(
        "run_id", "horizon", "direction", "u.min_entry", "u.eligible",
        F.coalesce("u.mean_net", F.lit(0.0)).alias("unconditional_mean_net_return"),
        F.coalesce("u.hit_rate", F.lit(0.0)).alias("unconditional_hit_rate"),
    )


def forbidden_entries(signals: DataFrame, horizons: Sequence[int], embargo: int) -> DataFrame:
    """Entries too close to any confirmed signal, each once per horizon.

    A signal forbids only what the signal before it does not, so nothing is named twice and nothing needs to be
    compared once the ranges are opened.
    """
    reach = max(horizons) - 1 + embargo
    p, before = F.col("entry_index"), F.col("_before")
    one = signals.select("run_id", "entry_index").filter(p.isNotNull()).distinct()
    one = over_halo(one, 2 * reach + 1, lambda w: {"_before": F.lag("entry_index").over(w)}, index="entry_index")
    h = F.explode(F.array(*[F.lit(int(x)) for x in horizons]))
    cut = one.withColumn("horizon", h).withColumn("_reach", F.col("horizon") - 1 + embargo)
    low = F.greatest(F.lit(0).cast("long"), p - F.col("_reach"), F.coalesce(before + F.col("_reach") + 1, F.lit(0).cast("long")))
    cut = cut.withColumns({"_low": low, "_high": p + F.col("_reach")}).filter("_low <= _high")
    return cut.select("run_id", "horizon", F.explode(F.sequence("_low", "_high")).alias("entry_index"))


def control_pool(
    states: DataFrame, bars_per_run: DataFrame | None, signals: DataFrame, horizons: Sequence[int],
    minimums: Sequence[int], embargo: int,
) -> DataFrame:
    """Eligible entries minus forbidden ones. ``states`` has trailing_vol and entry_spread.

    Signals are laid among the bars; the nearest one on each side tells every horizon whether it forbids the bar. Without
    ``bars_per_run`` a run ends with its last state, which the same frame tells.
    """
    reach = max(horizons) - 1 + embargo
    bars = states.select("run_id", "bar_index", "trailing_vol", "entry_spread").withColumn("_signal", F.lit(None).cast("long"))
    at = F.col("entry_index").cast("long")
    # A signal may be due on the bar after the last one; it forbids the bars before it all the same.
    marks = signals.filter(at.isNotNull()).select("run_id", at.alias("bar_index")).distinct().withColumns({
        "trailing_vol": F.lit(None).cast("double"), "entry_spread": F.lit(None).cast("double"), "_signal": F.col("bar_index")})

    def build(w):
        near = {"_last": F.max("_signal").over(w.rangeBetween(-reach, 0)), "_next": F.min("_signal").over(w.rangeBetween(0, reach))}
        if bars_per_run is None:  # the bar after the last one, where it is in reach
            near["_end"] = F.max(F.when(F.col("_bar"), F.col("bar_index"))).over(w.rangeBetween(0, max(horizons) - 1)) + 1
        return near

    near = over_halo(bars.withColumn("_bar", F.lit(True)).unionByName(marks.withColumn("_bar", F.lit(False))), reach, build, ahead=reach + 1)
    gap = F.least(F.col("bar_index") - F.col("_last"), F.col("_next") - F.col("bar_index"))
    free = near.filter("_bar").withColumn("_gap", gap).drop("_bar", "_signal", "_last", "_next")
    ok = _planned(free, "_end", horizons, minimums) if bars_per_run is None else eligible_entries(free, bars_per_run, horizons, minimums)
    return ok.filter(F.col("_gap").isNull() | (F.col("_gap") > F.col("horizon") - 1 + embargo)).drop("_gap")


def state_distance(vol: Column, spread: Column, vol0: Column, spread0: Column) -> Column:
    return F.abs(F.log((vol + EPS) / (vol0 + EPS))) + 0.25 * F.abs(F.log((spread + EPS) / (spread0 + EPS)))


def nearest_pool(pool: DataFrame, targets: DataFrame, size: int) -> DataFrame:
    """The ``size`` nearest pool entries of every target by (distance, index), exactly.

    ``targets``: run_id, horizon, min_entry, target, trailing_vol, entry_spread (distinct rows). Only pools with targets
    are indexed, and targets of equal state are searched for once.
    """
    u, v = F.log(F.col("trailing_vol") + EPS), 0.25 * F.log(F.col("entry_spread") + EPS)
    group = F.struct(*POOL).alias("g")
    q = written(targets.select(group, "target", u.alias("pu"), v.alias("pv")).dropna(), "nearest-targets")
    points = pool.select(group, F.col("entry_index").alias("id"), u.alias("u"), v.alias("v")).dropna()
    points = sorted_join(points, q.select("g").distinct(), "g", "left_semi")
    found = nearest_points(points, q.select("g", "pu", "pv").distinct(), size)
    return sorted_join(q, found, ["g", "pu", "pv"]).select(
        "g.*", "target", F.col("id").alias("entry_index"), "distance", F.col("rank").alias("pool_rank"))


def draw_controls(pool: DataFrame, draws: DataFrame, count: int) -> DataFrame:
    """Draw ``count`` pool members per trade in the order of a hash that knows only the causal price
    prefix and the strategy coordinates; take all when the pool is not larger."""
    d = draws.select(*POOL, "target", "pattern_name", "prefix")
    j = sorted_join(d, pool, [*POOL, "target"])
    key = F.md5(F.concat_ws("|", "prefix", "pattern_name", F.col("target").cast("string"),
                            F.col("horizon").cast("string"), F.col("entry_index").cast("string")))
    w = Window.partitionBy(*POOL, "target", "pattern_name").orderBy(key, "entry_index")
    return j.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= count).drop("_n", "prefix")


def control_returns(drawn: DataFrame, trades: DataFrame, exits: DataFrame, minimum: int, horizons: Sequence[int], costs: CostModel = CostModel()) -> DataFrame:
    """Null mean and accuracy per trade; NULL when fewer than ``minimum`` controls exist. Trades of one set of controls share its means."""
    keys = [*POOL, "target", "pattern_name"]
    t = trades.select(*POOL, "pattern_name", "event_id", "hypothesis", "direction", F.col("entry_index").alias("target"))
    priced = looked_up(drawn, exits, horizons)
    sides = []
    for name, side in (("_long", 1), ("_short", -1)):
        r = round_trip(F.col("entry_mid"), F.col("exit_mid"), F.lit(side), F.col("entry_spread"), F.col("exit_spread"), costs)
        sides += [F.avg(r["net_return"]).alias(f"{name}_m"), F.avg((r["gross_return"] > 0).cast("double")).alias(f"{name}_a")]
    means = priced.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *sides)
    taken = lambda what: F.when(F.col("direction") > 0, F.col(f"_long_{what}")).otherwise(F.col(f"_short_{what}"))
    got = sorted_join(t, means, keys).withColumns({"_m": taken("m"), "_a": taken("a")})
    return got.select(
        "run_id", "hypothesis", "horizon", "event_id", F.col("_n").alias("matched_null_count"),
        F.when(F.col("_n") >= minimum, F.col("_m")).alias("matched_null_mean_net_return"),
        F.when(F.col("_n") >= minimum, F.col("_a")).alias("matched_null_direction_accuracy"))


def running_fingerprint(bars: DataFrame, text: Column, name: str, *, chunk: int = 65_536, at: DataFrame | None = None) -> DataFrame:
    """Fingerprint of all rows of a run up to each bar.

    Every bar gives a position-bound hash number (``text`` must hold the bar index); the running sum
    of those numbers is hashed. Unlike a hash chain this needs no sequential pass over the run, and
    a later bar cannot change an earlier prefix. With ``at`` (run_id, bar_index, each once) only the prefixes of those bars
    leave the scan: they are laid among the bars, so no table of all prefixes is joined.
    """
    number = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    x = bars.select("run_id", "bar_index", number.alias("_x"), F.floor(F.col("bar_index") / chunk).cast("long").alias("_b"))
    if at is None:
        s = bucketed_scan(x, ["run_id"], "_b", ["bar_index"], {"_sum": ("sum", "_x")})
    else:
        marks = at.select("run_id", F.col("bar_index").cast("long").alias("bar_index"), F.lit(0).cast("decimal(38,0)").alias("_x"),
                          F.floor(F.col("bar_index") / chunk).cast("long").alias("_b"), F.lit(True).alias("_mark"))
        x = x.withColumn("_mark", F.lit(False)).unionByName(marks)
        x = x.withColumn("_bar", F.lag("bar_index").over(Window.partitionBy("run_id", "_b").orderBy("bar_index", "_mark")))
        s = bucketed_scan(x, ["run_id"], "_b", ["bar_index", "_mark"], {"_sum": ("sum", "_x")})
        s = s.filter(F.col("_mark") & (F.col("_bar") == F.col("bar_index")))  # a mark follows its bar, where there is one
    return s.select("run_id", "bar_index", F.sha2(F.concat_ws(
        ":", F.col("bar_index").cast("string"), F.col("_sum").cast("decimal(38,0)").cast("string")), 256).alias(name))


def bar_text(columns: Sequence[str]) -> Column:
    """Position-bound text of a bar: index and values with all the digits that tell doubles apart."""
    parts = [F.col(c).cast("string") for c in columns]
    return F.concat_ws("|", F.col("bar_index").cast("string"), *parts)


def price_prefixes(bars: DataFrame, at: DataFrame | None = None) -> DataFrame:
    """Causal OHLCV prefix. Names, labels and times do not enter. ``at`` names the bars wanted (default: all)."""
    text = F.concat_ws("|", bar_text(["open", "high", "low", "close"]), F.col("volume").cast("string"))
    return running_fingerprint(bars, text, "prefix", at=at)


def seeded_draws(taken: DataFrame, bars: DataFrame) -> DataFrame:
    """What controls are drawn for, each once, with the price prefix known at its signal."""
    draws = taken.select(*POOL, F.col("entry_index").alias("target"), "pattern_name", "available_at_index").distinct()
    at = draws.select("run_id", F.col("available_at_index").alias("bar_index")).distinct()
    seeds = price_prefixes(bars, at).withColumnRenamed("bar_index", "available_at_index")
    return sorted_join(draws, seeds, ["run_id", "available_at_index"])


def observations(
    bars: DataFrame, events: DataFrame, trades: DataFrame, procedure: ProcedureConfig,
    exits: DataFrame, states: DataFrame, minimums: Sequence[int],
) -> DataFrame:
    """One row per accepted trade with its return, unconditional mean and matched-null columns.

    ``exits``: :func:`horizon_exits` of the bars. ``states`` has a row for every bar.
    """
    taken = trades.filter("status = 'accepted'").withColumn(
        "min_entry", minimum_entry(F.col("observation_window_length"), F.col("entry_index") - F.col("available_at_index")))
    quotes = ["entry_mid", "exit_mid", "entry_spread", "exit_spread"]
    found = looked_up(taken, exits, procedure.horizons)
    returns = round_trip(*[F.col(c) for c in quotes[:2]], F.col("direction"), *[F.col(c) for c in quotes[2:]], procedure.costs)
    priced = found.withColumns(returns).drop(*quotes)
    base = unconditional(exit_outcomes(exits, procedure.horizons, procedure.costs), minimums).drop("eligible", "unconditional_hit_rate")
    signals = events.filter(F.col("direction").isNotNull())
    pool = control_pool(states, None, signals, procedure.horizons, minimums, procedure.embargo)
    c = procedure.controls_per_event
    at = states.select("run_id", F.col("bar_index").alias("target"), "trailing_vol", "entry_spread")
    wanted = taken.select(*POOL, F.col("entry_index").alias("target")).distinct()
    nearest = nearest_pool(pool, sorted_join(wanted, at, ["run_id", "target"]), max(c, 5 * c))
    drawn = draw_controls(nearest.drop("distance", "pool_rank"), seeded_draws(taken, bars), c)
    nulls = control_returns(drawn, taken, exits, procedure.min_controls, procedure.horizons, procedure.costs)
    return (
        sorted_join(sorted_join(priced, base, [*POOL, "direction"], "left"), nulls, ["run_id", "hypothesis", "horizon", "event_id"], "left")
        .withColumn("matched_null_count", F.coalesce("matched_null_count", F.lit(0).cast("long")))
        .withColumn("directional_correct", F.col("gross_return") > 0)
    )
