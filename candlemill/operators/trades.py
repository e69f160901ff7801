"""Directions, costs, returns and excursions of trades (pure column arithmetic)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from candlemill.config import ALL_PATTERNS, PATTERN_NAMES, CostModel
from candlemill.functions.columns import divide
from candlemill.functions.windows import over_halo
from candlemill.sources.series import sorted_join


def trade_direction(confirmed: Column, breakout: Column) -> Column:
    """+1 / -1 from a breakout known at availability; the expected direction is never used."""
    return F.when(confirmed & (breakout == "bullish"), 1).when(confirmed & (breakout == "bearish"), -1)


def round_trip(
    entry_mid: Column, exit_mid: Column, direction: Column, entry_spread: Column, exit_spread: Column,
    costs: CostModel = CostModel(),
) -> dict[str, Column]:
    """Gross and net return of one unit, all parts normalised by the entry mid.

    Half a spread plus slippage is lost on each side; brokerage is paid on both fills. Over an entry mid of zero the parts are
    infinite or not numbers; :func:`untradeable_prices` names such rows.
    """
    slip, fee = costs.slippage_bps_per_side / 1e4, costs.brokerage_bps_per_side / 1e4
    d = direction.cast("double")
    fill_in = entry_mid * (1.0 + d * (0.5 * entry_spread + slip))
    fill_out = exit_mid * (1.0 - d * (0.5 * exit_spread + slip))
    gross = divide(d * (exit_mid - entry_mid), entry_mid)
    traded = divide(d * (fill_out - fill_in), entry_mid)
    brokerage = divide(fee * (fill_in + fill_out), entry_mid)
    return {
        "gross_return": gross,
        "spread_slippage_cost": gross - traded,
        "brokerage_cost": brokerage,
        "total_transaction_cost": gross - traded + brokerage,
        "net_return": traded - brokerage,
    }


def untradeable_prices(df: DataFrame, costs: CostModel = CostModel()) -> DataFrame:
    """Rows whose prices or spreads break the execution-price model."""
    slip = costs.slippage_bps_per_side / 1e4
    ok = (
        (F.col("entry_mid") > 0) & (F.col("exit_mid") > 0)
        & (F.col("entry_spread") >= 0) & (F.col("exit_spread") >= 0)
        & (0.5 * F.col("entry_spread") + slip < 1) & (0.5 * F.col("exit_spread") + slip < 1)
    )
    return df.filter(~F.coalesce(ok, F.lit(False)))


def horizon_exits(bars: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """One row per entry bar: its mid and spread and, as ``_x<H>``, those at the exit of every horizon (exit = entry + H - 1).

    One look-ahead frame per chunk serves all horizons. What is looked up by entry meets this table, which is much smaller than that of
    all horizons and directions.
    """
    horizons = sorted(set(horizons))

    def build(w):
        return {
            f"_x{h}": F.struct(
                F.lead("exit_mid", h - 1).over(w).alias("exit_mid"),
                F.lead("exit_spread", h - 1).over(w).alias("exit_spread"),
            )
            for h in horizons
        }

    wide = over_halo(
        bars.select("run_id", "bar_index", "entry_mid", "exit_mid", "entry_spread", "exit_spread"),
        0, build, ahead=max(horizons),
    )
    return wide.select("run_id", F.col("bar_index").alias("entry_index"), "entry_mid", "entry_spread", *[f"_x{h}" for h in horizons])


def looked_up(rows: DataFrame, exits: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """``rows`` (run_id, entry_index, horizon) beside entry_mid, entry_spread, exit_mid and exit_spread; entries whose exit lies past the end drop out."""
    x = F.coalesce(*[F.when(F.col("horizon") == h, F.col(f"_x{h}")) for h in sorted(set(horizons))])
    met = sorted_join(rows, exits, ["run_id", "entry_index"]).withColumn("_x", x).filter(F.col("_x.exit_mid").isNotNull())
    return met.select(*rows.columns, "entry_mid", "entry_spread", F.col("_x.exit_mid").alias("exit_mid"), F.col("_x.exit_spread").alias("exit_spread"))


def horizon_outcomes(bars: DataFrame, horizons: Sequence[int], costs: CostModel = CostModel()) -> DataFrame:
    """Outcome of entering at every bar, per horizon and direction; entries whose exit lies past the end drop out."""
    return exit_outcomes(horizon_exits(bars, horizons), horizons, costs)


def exit_outcomes(exits: DataFrame, horizons: Sequence[int], costs: CostModel = CostModel()) -> DataFrame:
    """The rows of :func:`horizon_outcomes` from :func:`horizon_exits`."""
    plans = F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.lit(d).alias("direction"), F.col(f"_x{h}").alias("x"))
        for h in sorted(set(horizons)) for d in (-1, 1)
    ])
    flat = exits.select(
        "run_id", "entry_index", F.col("entry_mid").alias("_em"), F.col("entry_spread").alias("_es"), F.explode(plans).alias("p"),
    ).filter(F.col("p.x.exit_mid").isNotNull())
    return flat.select(
        "run_id", "entry_index", "p.horizon", "p.direction",
        F.col("_em").alias("entry_mid"), F.col("p.x.exit_mid").alias("exit_mid"),
        F.col("_es").alias("entry_spread"), F.col("p.x.exit_spread").alias("exit_spread"),
    ).withColumns(
        round_trip(F.col("entry_mid"), F.col("exit_mid"), F.col("direction"), F.col("entry_spread"), F.col("exit_spread"), costs)
    )


def excursions(bars: DataFrame, horizon: int) -> DataFrame:
    """Highest high and lowest low over [entry, entry + H - 1] for every entry bar."""

    def build(w):
        f = w.rowsBetween(0, horizon - 1)
        return {"_hi": F.max("high").over(f), "_lo": F.min("low").over(f), "_n": F.count("high").over(f)}

    return over_halo(bars, 0, build, ahead=horizon).filter(F.col("_n") == horizon)


def excursion_columns(direction: Column, entry_mid: Column, high: Column, low: Column) -> dict[str, Column]:
    up, down = divide(high, entry_mid) - 1.0, divide(low, entry_mid) - 1.0
    return {
        "maximum_favorable_excursion": F.greatest(F.lit(0.0), F.when(direction > 0, up).otherwise(-down)),
        "maximum_adverse_excursion": F.least(F.lit(0.0), F.when(direction > 0, down).otherwise(-up)),
    }


def family_rank(name: Column) -> Column:
    position = F.array_position(F.array(*[F.lit(n) for n in PATTERN_NAMES]), name)
    return F.when(position > 0, position - 1).otherwise(F.lit(len(PATTERN_NAMES)))


def signal_priority(
    name: str = "pattern_name", available: str = "available_at_index", start: str = "start_index",
    end: str = "end_index", observation: str = "observation_window_length", core: str = "core_window_length",
    fit: str = "geometry_fit_score",
) -> Column:
    """Shared tie-break of simultaneous signals: family, coordinates, scale, then fit."""
    num = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return F.struct(
        family_rank(F.col(name)).cast("int").alias("family"), F.col(name).alias("name"), num(available).alias("a"),
        num(start).alias("s"), num(end).alias("e"), num(observation).alias("o"), num(core).alias("c"),
        (-num(fit)).alias("f"),
    )


def with_portfolio(events: DataFrame, name: str = "pattern_name") -> DataFrame:
    """Every event once under its own family and once under the all-pattern portfolio label."""
    return events.withColumn("hypothesis", F.explode(F.array(F.col(name), F.lit(ALL_PATTERNS))))
