"""One-position overlap rules.

``skip_new`` is sequential: a signal is ignored while the last accepted trade is open. It is run
here without putting a run into one task. Each chunk of entries is turned into a small map from
"how many bars into this chunk is a position still open" to the same for the next chunk. Maps are
composed in groups of 64, groups in groups of 64, and so on; the starts then come down the same
levels. No row ever holds more than 64 maps or one chunk of signals, however dense the signals are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from candlemill.functions.windows import CHUNK
from candlemill.operators.trades import signal_priority
from candlemill.sources.series import sorted_join, written


def resolve_same_entry(events: DataFrame, keys: Sequence[str], priority: Column | None = None) -> DataFrame:
    """Signals of one entry bar are one set: opposite directions cancel it, else the first by
    priority stands. Adds ``_rank`` (1 = kept) and ``_conflict``."""
    priority = signal_priority() if priority is None else priority
    groups = Window.partitionBy(*keys, "entry_index")
    return events.withColumns({
        "_conflict": F.min("direction").over(groups) != F.max("direction").over(groups),
        "_rank": F.row_number().over(groups.orderBy(priority, "event_id")),
    })


FAN = 64


def skip_new(
    trades: DataFrame, keys: Sequence[str], max_hold: int | None = None, *, chunk: int = CHUNK // 4, name: str = "accepted"
) -> DataFrame:
    """Mark the trades taken when new signals are skipped while a position is open.

    ``trades`` has at most one row per (keys, entry_index). The longest hold is read from the
    trades; ``max_hold`` is only a lower bound for it. Chunks are at least one longest hold long.
    """
    keys = list(keys)
    seen = trades.agg(F.max(F.col("exit_index") - F.col("entry_index")).alias("h"), F.max("entry_index").alias("e")).head()
    if seen["e"] is None:
        return trades.withColumn(name, F.lit(False))
    hold = max(int(max_hold or 0), int(seen["h"]), 0)
    chunk = chunk * (hold // chunk + 1)
    cut = trades.withColumn("_c", F.floor(F.col("entry_index") / chunk).cast("long"))
    chunks = cut.groupBy(*keys, "_c").agg(
        F.sort_array(F.collect_list(F.struct("entry_index", "exit_index"))).alias("_sig")
    )
    edge = F.col("_c") * chunk

    def fold(start: Column) -> Column:
        return F.aggregate(
            "_sig", start,
            lambda open_until, s: F.when(s["entry_index"] > open_until, s["exit_index"]).otherwise(open_until),
        )

    # slot s: the position is open until bar (edge + s - 1); 0 means that none is open
    slot = lambda open_until, at: F.greatest(F.lit(0).cast("long"), open_until - at + 1).cast("int")
    slots = F.sequence(F.lit(0), F.lit(hold))
    levels = [written(chunks.select(
        *keys, "_c", F.transform(slots, lambda s: slot(fold((edge + s - 1).cast("long")), edge + chunk)).alias("_map")), "hold-maps")]

    def through(acc, row):
        """State (next chunk, slot) after one more map; a gap before it closes every position."""
        there = F.when(acc["next"] == row["_c"], acc["slot"]).otherwise(F.lit(0))
        return F.struct((row["_c"] + 1).alias("next"), F.get(row["_map"], there).alias("slot"))

    def state(at: Column, s: Column) -> Column:
        return F.struct(at.cast("long").alias("next"), s.cast("int").alias("slot"))

    top = int(seen["e"]) // chunk
    while top > 0:
        top //= FAN
        inside = levels[-1].withColumn("_g", F.floor(F.col("_c") / FAN).cast("long")).groupBy(*keys, "_g").agg(
            F.sort_array(F.collect_list(F.struct("_c", "_map"))).alias("_rows"))

        def whole(s: Column) -> Column:
            end = F.aggregate("_rows", state(F.col("_g") * FAN, s), through)
            return F.when(end["next"] == (F.col("_g") + 1) * FAN, end["slot"]).otherwise(F.lit(0))

        levels.append(written(inside.select(*keys, F.col("_g").alias("_c"), F.transform(slots, whole).alias("_map")), "hold-maps"))
    starts = levels[-1].select(*keys, "_c", F.lit(0).alias("_slot"))
    for below in reversed(levels[:-1]):
        inside = below.withColumn("_g", F.floor(F.col("_c") / FAN).cast("long")).groupBy(*keys, "_g").agg(
            F.sort_array(F.collect_list(F.struct("_c", "_map"))).alias("_rows"))
        inside = sorted_join(inside, starts.withColumnRenamed("_c", "_g"), [*keys, "_g"])

        def open_at(row: Column) -> Column:
            """Slot at the start of this member: the state after the members before it."""
            end = F.aggregate(F.filter("_rows", lambda r: r["_c"] < row["_c"]), state(F.col("_g") * FAN, F.col("_slot")), through)
            return F.when(end["next"] == row["_c"], end["slot"]).otherwise(F.lit(0))

        starts = inside.select(*keys, F.explode(F.transform("_rows", lambda r: F.struct(r["_c"].alias("_c"), open_at(r).alias("_slot")))).alias("_s")).select(
            *keys, "_s._c", "_s._slot")

    def take(acc, s):
        fresh = s["entry_index"] > acc["open"]
        return F.struct(
            F.when(fresh, s["exit_index"]).otherwise(acc["open"]).alias("open"),
            F.when(fresh, F.concat(acc["kept"], F.array(s["entry_index"]))).otherwise(acc["kept"]).alias("kept"),
        )

    kept0 = F.struct((edge + F.col("_slot") - 1).cast("long").alias("open"), F.array().cast("array<bigint>").alias("kept"))
    kept = (
        sorted_join(chunks, starts, [*keys, "_c"])
        .select(*keys, F.explode(F.aggregate("_sig", kept0, take)["kept"]).alias("entry_index"))
        .withColumn(name, F.lit(True))
    )
    return sorted_join(trades, kept, [*keys, "entry_index"], "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def overlap_filter(
    events: DataFrame, bars_per_run: DataFrame, horizons: Sequence[int], policy: str = "skip_new"
) -> DataFrame:
    """Statistical overlap policy per (run, hypothesis, horizon).

    Adds ``status``: accepted, skipped or untradeable. Events without direction or with an exit past
    the last bar are untradeable.
    """
    if policy not in ("skip_new", "allow"):
        raise ValueError("policy must be skip_new or allow")
    keys = ["run_id", "hypothesis", "horizon"]
    grid = F.explode(F.array(*[F.lit(int(h)) for h in sorted(set(horizons))]))
    plan = (
        sorted_join(events.withColumn("horizon", grid), bars_per_run.select("run_id", "n_bars"), "run_id")
        .withColumn("exit_index", F.col("entry_index") + F.col("horizon") - 1)
        .withColumn("_ok", F.col("direction").isNotNull() & F.col("entry_index").isNotNull()
                    & (F.col("entry_index") >= 0) & (F.col("exit_index") < F.col("n_bars")))
    )
    bad = plan.filter(~F.coalesce("_ok", F.lit(False))).withColumn("status", F.lit("untradeable"))
    # Read several times below: written once instead of being recomputed.
    good = written(resolve_same_entry(plan.filter("_ok"), keys), "signals")
    lost = good.filter("_conflict OR _rank > 1").withColumn("status", F.lit("skipped"))
    first = good.filter("NOT _conflict AND _rank = 1")
    if policy == "skip_new":
        first = skip_new(first, keys, max(horizons) - 1)
        first = first.withColumn("status", F.when(F.col("accepted"), "accepted").otherwise("skipped")).drop("accepted")
    else:
        first = first.withColumn("status", F.lit("accepted"))
    drop = ["_ok", "_rank", "_conflict", "n_bars"]
    return first.drop(*drop).unionByName(lost.drop(*drop)).unionByName(bad.drop(*drop))


TIE = 1e-12


def resolve_scored_entry(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Probability-aware same-entry rule: rows tied to the top score compete; a tie between opposite
    directions yields nothing, otherwise the shared priority decides. Adds ``_winner``."""
    g = Window.partitionBy(*keys, "entry_index")
    top = F.max("probability").over(g)
    tied = F.abs(F.col("probability") - top) <= TIE
    rows = rows.withColumn("_tied", tied)
    side = F.when(F.col("_tied"), F.col("trade_direction"))
    optional = {"available_at_index", "pattern_start_index", "pattern_end_index", "observation_window_length",
                "core_window_length", "geometry_fit_score"} - set(rows.columns)
    rows = rows.withColumns({c: F.lit(None).cast("double") for c in optional})
    order = signal_priority("pattern_type", "available_at_index", "pattern_start_index", "pattern_end_index")
    rows = rows.withColumns({
        "_clash": F.min(side).over(g) != F.max(side).over(g),
        "_place": F.row_number().over(g.orderBy(F.col("_tied").desc(), order, "row_id")),
    })
    return rows.withColumn("_winner", F.col("_tied") & ~F.col("_clash") & (F.col("_place") == 1)).drop(
        "_tied", "_clash", "_place", *optional
    )


def select_trades(rows: DataFrame, thresholds: Sequence[float], max_hold: int) -> DataFrame:
    """Non-overlapping trades at every threshold: filter by score first, then same-entry, then
    skip_new per run. Rows carry ``threshold`` and ``executed``."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds]))
    cand = rows.withColumn("threshold", t).filter(F.col("probability") >= F.col("threshold"))
    keys = ["run_id", "threshold"]
    cand = written(resolve_scored_entry(cand, keys), "scored")
    won = skip_new(cand.filter("_winner"), keys, max_hold, name="executed")
    rest = cand.filter("NOT _winner").withColumn("executed", F.lit(False))
    return won.unionByName(rest).drop("_winner")


def selection_masks(rows: DataFrame, threshold: float, max_hold: int) -> DataFrame:
    """Candidate and executed flags for every row, kept in full."""
    done = select_trades(rows, [threshold], max_hold).filter("executed").select("row_id").withColumn("executed", F.lit(1))
    return rows.join(done, "row_id", "left").withColumns({
        "candidate": (F.col("probability") >= threshold).cast("int"),
        "executed": F.coalesce("executed", F.lit(0)),
    })
