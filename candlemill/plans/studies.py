"""End-to-end studies assembled from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from candlemill.config import ALL_PATTERNS, PATTERN_NAMES, PatternConfig, ProcedureConfig
from candlemill.operators import controls as N, features as T, inference as I, overlap as O, trades as X
from candlemill.patterns import detect as D
from candlemill.sources.series import written


def pattern_study(
    bars: DataFrame, runs: DataFrame, config: PatternConfig = PatternConfig(), procedure: ProcedureConfig = ProcedureConfig()
) -> dict[str, DataFrame]:
    """Detect, trade confirmed breakouts, match controls and aggregate: one table per stage.

    ``bars`` need run_id, bar_index, OHLC, volume and the four execution columns; ``runs`` need
    run_id, structure_id and seed and may hold runs without bars.
    """
    found = D.detect(bars, config, context=False)
    events = D.confirmed_events(found.candidates).withColumn(
        "direction", X.trade_direction(F.col("breakout_confirmed"), F.col("breakout_direction")))
    events = written(events, "events")
    n_bars = bars.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_bars"))
    trades = written(O.overlap_filter(X.with_portfolio(events), n_bars, procedure.horizons, procedure.overlap_policy), "trades")
    exits = written(X.horizon_exits(bars, procedure.horizons), "exits")
    states = bars.select("run_id", "bar_index", "close", "entry_spread")
    states = written(T.trailing_volatility(states, procedure.volatility_lookback).drop("close"), "states")
    obs = written(N.observations(bars, events, trades, procedure, exits, states, N.minimum_entries(config)), "observations")
    metrics = written(I.run_metrics(I.run_grid(runs, procedure.horizons), trades, obs), "metrics")
    return {
        "candidates": found.candidates, "events": events, "clusters": found.clusters, "trades": trades,
        "observations": obs, "metrics": metrics, "hypotheses": I.aggregate_metrics(metrics, procedure),
    }


def pattern_returns(bars: DataFrame, runs: DataFrame, config: PatternConfig = PatternConfig(), procedure: ProcedureConfig = ProcedureConfig()) -> DataFrame:
    """Net return of confirmed pattern trades per (pattern, horizon) over the complete run grid."""
    found = D.detect(bars, config, context=False)
    events = D.confirmed_events(found.candidates).withColumn(
        "direction", X.trade_direction(F.col("breakout_confirmed"), F.col("breakout_direction")))
    n_bars = bars.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_bars"))
    trades = O.overlap_filter(X.with_portfolio(events), n_bars, procedure.horizons, procedure.overlap_policy).filter("status = 'accepted'")
    outcomes = X.horizon_outcomes(bars, procedure.horizons, procedure.costs)
    priced = trades.join(outcomes, ["run_id", "horizon", "direction", "entry_index"])
    g = priced.groupBy("run_id", "hypothesis", "horizon").agg(
        F.count(F.lit(1)).alias("n"), F.sum("net_return").alias("net"), F.sum("gross_return").alias("gross"),
        F.sum((F.col("gross_return") > 0).cast("long")).alias("hits"))
    grid = I.run_grid(runs.select("run_id"), procedure.horizons)
    full = grid.join(g, ["run_id", "hypothesis", "horizon"], "left")
    zero = lambda c, v: F.coalesce(F.sum(c), F.lit(v))
    return full.groupBy("hypothesis", "horizon").agg(
        F.count(F.lit(1)).alias("runs"), F.count("n").alias("runs_with_trades"), zero("n", 0).alias("trades"),
        zero("hits", 0).alias("winning_trades"), zero("gross", 0.0).alias("gross_return_points"), zero("net", 0.0).alias("net_return_points"))
