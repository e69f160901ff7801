"""AGG13-AGG26 and CLS rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from candlemill.catalog import sql as S
from candlemill.catalog.bars_and_features import W, r6
from candlemill.catalog.registry import add
from candlemill.catalog.tdist_sql import ci_columns, critical_cte, p_expr
from candlemill.catalog.trading import PFAM, THRESHOLDS, scored_sql
from candlemill.config import ExperimentConfig
from candlemill.functions.columns import divide, ln
from candlemill.operators import classification as C, features as T, overlap as O, portfolio as P
from candlemill.sources import views as V

HOLD = 3
FEATURES = ["o_totalprice_k", "probability_raw", "hold"]


def trades(s, d) -> DataFrame:
    return V.order_trades(s, d)


def universe(s, d) -> DataFrame:
    return V.customer_runs(s, d)


def labelled(s, d) -> DataFrame:
    return trades(s, d).withColumn("label", F.col("profitable"))


def with_structure(s, d) -> DataFrame:
    return trades(s, d).join(universe(s, d), "run_id")


def tvals(ts):
    return ", ".join(f"({t!r}::DOUBLE)" for t in ts)


def econ_sql(thresholds, source="trades", name="ec") -> str:
    lo, hi = ci_columns("n_u", "m_u", "s_u", "u")
    return f"""{scored_sql(thresholds, source)},
ex AS (SELECT sq.* FROM sq JOIN sr ON sr.run_id = sq.run_id AND sr.threshold = sq.threshold AND sr.rn = sq.rn AND sr.acc),
cu AS (SELECT *, sum(net_directional_return) OVER (PARTITION BY run_id, threshold ORDER BY entry_index) AS cum FROM ex),
pk AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY run_id, threshold ORDER BY entry_index)) - cum AS fall FROM cu),
rt AS (SELECT run_id, threshold, sum(net_directional_return) AS tot, count(*) AS n, max(fall) AS dd FROM pk GROUP BY 1, 2),
ug AS (SELECT runs.run_id, structure_id, world_family, th.threshold FROM runs, (VALUES {tvals(thresholds)}) th(threshold)),
ur AS (SELECT ug.*, coalesce(tot, 0) AS tot, coalesce(n, 0) AS n, coalesce(dd, 0) AS dd FROM ug LEFT JOIN rt ON rt.run_id = ug.run_id AND rt.threshold = ug.threshold),
su2 AS (SELECT threshold, structure_id, avg(tot) AS unit FROM ur GROUP BY 1, 2),
ui AS (SELECT threshold, count(*) AS n_u, avg(unit) AS m_u, stddev_samp(unit) AS s_u FROM su2 GROUP BY 1),
ra AS (SELECT threshold, count(*) FILTER (n > 0) AS selected_runs, median(tot) AS med, avg(dd) AS mdd FROM ur GROUP BY 1),
ca AS (SELECT threshold, count(*) AS cand FROM sc GROUP BY 1),
ea AS (SELECT threshold, count(*) AS tr, avg(profitable) AS win, avg(net_directional_return) AS mn, median(net_directional_return) AS mdn FROM ex GROUP BY 1),
{name} AS (SELECT ra.threshold, coalesce(cand, 0) AS candidate_selected_trades, coalesce(tr, 0) AS selected_trades, selected_runs, n_u AS inference_structures,
  coalesce(tr, 0) / (SELECT greatest(1, count(*)) FROM {source})::DOUBLE AS selection_rate, win AS selected_success_rate, mn AS mean_selected_net_return, mdn AS median_selected_net_return,
  m_u AS mean_run_net_return_points, {lo} AS mean_run_net_return_points_ci_low, {hi} AS mean_run_net_return_points_ci_high, med AS median_run_net_return_points, mdd AS mean_run_max_drawdown_return_points
  FROM ra JOIN ui ON ui.threshold = ra.threshold LEFT JOIN ca ON ca.threshold = ra.threshold LEFT JOIN ea ON ea.threshold = ra.threshold LEFT JOIN tcrit tc_u ON tc_u.df = n_u - 1)"""


BASE = f"{S.ORDER_TRADES}, {S.CUSTOMER_RUNS}, {critical_cte()}"
E_INT = ["candidate_selected_trades", "selected_trades", "selected_runs", "inference_structures"]
E_REAL = ["selection_rate", "selected_success_rate", "mean_selected_net_return", "median_selected_net_return", "mean_run_net_return_points",
          "mean_run_net_return_points_ci_low", "mean_run_net_return_points_ci_high", "median_run_net_return_points", "mean_run_max_drawdown_return_points"]


def _units(s, d):
    picked = O.select_trades(trades(s, d), [0.5], HOLD).filter("executed").drop("threshold")
    per_run = P.run_totals(universe(s, d), picked, [])
    return P.structure_units(per_run, "run_return").select("structure_id", r6("unit", digits=13))


add("AGG13_structure_units", _units,
    f"WITH RECURSIVE {BASE}, {econ_sql([0.5])} SELECT structure_id, round(unit, 13) AS unit FROM su2")
add(
    "AGG14_economic_metrics",
    lambda s, d: P.economic_metrics(trades(s, d), universe(s, d), [0.5], HOLD).select(r6("threshold"), *E_INT, *[r6(c, digits=13) for c in E_REAL]),
    f"WITH RECURSIVE {BASE}, {econ_sql([0.5])} SELECT round(threshold, 6) AS threshold, {', '.join(E_INT)}, {S.pick(E_REAL, 13)} FROM ec",
)
add(
    "AGG15_max_drawdown",
    lambda s, d: P.run_drawdown(O.select_trades(trades(s, d), [0.0], HOLD).filter("executed"), ["run_id"], "net_directional_return", "entry_index").select(
        "run_id", r6("max_drawdown", digits=13)),
    f"WITH RECURSIVE {BASE}, {econ_sql([0.0])} SELECT run_id, round(dd, 13) AS max_drawdown FROM rt",
)
ONE = f"trades1 AS (SELECT * REPLACE (1.0::DOUBLE AS probability) FROM trades)"
add(
    "AGG16_baseline_metrics",
    lambda s, d: P.baseline_metrics(trades(s, d), universe(s, d), HOLD).select(
        *[f"baseline_{c}" for c in E_INT], *[r6(f"baseline_{c}", digits=13) for c in E_REAL]),
    f"""WITH RECURSIVE {BASE}, {ONE}, {econ_sql([0.5], 'trades1')} SELECT {', '.join(f'{c} AS baseline_{c}' for c in E_INT)},
    {', '.join(S.r(c, f'baseline_{c}', 13) for c in E_REAL)} FROM ec""",
)
_lo, _hi = ci_columns("n", "m", "sd", "x")
_second = econ_sql([0.5], "trades1", "ec2")
for _t in ("sc", "st", "su", "sq", "sr", "ex", "cu", "pk", "rt", "ug", "ur", "su2", "ui", "ra", "ca", "ea"):
    _second = __import__("re").sub(rf"\b{_t}\b", f"z_{_t}", _second)
add(
    "AGG17_paired_uplift",
    lambda s, d: P.paired_uplift(trades(s, d), universe(s, d), 0.6, HOLD).select(
        r6("mean_uplift", digits=13), r6("uplift_ci_low", digits=13), r6("uplift_ci_high", digits=13), r6("uplift_p_value"), r6("outperforms_run_fraction"),
        r6("equals_run_fraction"), "evaluation_runs", "inference_structures"),
    f"""WITH RECURSIVE {BASE}, {ONE}, {econ_sql([0.6])}, {_second},
    df AS (SELECT ur.run_id, ur.structure_id, ur.tot - z_ur.tot AS u FROM ur JOIN z_ur ON z_ur.run_id = ur.run_id),
    un AS (SELECT structure_id, avg(u) AS unit FROM df GROUP BY 1), ag AS (SELECT count(*) AS n, avg(unit) AS m, stddev_samp(unit) AS sd FROM un),
    sh AS (SELECT avg(CASE WHEN u > 0 THEN 1.0 ELSE 0.0 END) AS w, avg(CASE WHEN u = 0 THEN 1.0 ELSE 0.0 END) AS e, count(*) AS c FROM df)
    SELECT round(m, 13) AS mean_uplift, round({_lo}, 13) AS uplift_ci_low, round({_hi}, 13) AS uplift_ci_high, round({p_expr('n', 'm', 'sd')}, 6) AS uplift_p_value,
      round(w, 6) AS outperforms_run_fraction, round(e, 6) AS equals_run_fraction, c AS evaluation_runs, n AS inference_structures FROM ag JOIN sh ON true LEFT JOIN tcrit tc_x ON tc_x.df = n - 1""",
)
add(
    "AGG18_family_metrics",
    lambda s, d: P.by_family(trades(s, d), universe(s, d), 0.5, HOLD).select("family", "test_runs", "test_observations",
        r6("mean_run_net_return_points", digits=13), r6("selected_success_rate")),
    f"""WITH RECURSIVE {BASE}, {econ_sql([0.5])}, fm AS (SELECT *, CASE WHEN world_family = 'structured' THEN 'structured' ELSE 'null' END AS family FROM ur),
    fu AS (SELECT family, structure_id, avg(tot) AS unit FROM fm GROUP BY 1, 2), f1 AS (SELECT family, avg(unit) AS m FROM fu GROUP BY 1),
    f2 AS (SELECT family, count(*) AS test_runs FROM fm GROUP BY 1), f3 AS (SELECT family, count(*) AS o FROM trades JOIN fm ON fm.run_id = trades.run_id GROUP BY 1),
    f4 AS (SELECT family, avg(profitable) AS w FROM ex JOIN fm ON fm.run_id = ex.run_id GROUP BY 1)
    SELECT f2.family, test_runs, o AS test_observations, round(m, 13) AS mean_run_net_return_points, round(w, 6) AS selected_success_rate
    FROM f2 JOIN f1 ON f1.family = f2.family LEFT JOIN f3 ON f3.family = f2.family LEFT JOIN f4 ON f4.family = f2.family""",
)
add(
    "AGG19_per_pattern_metrics",
    lambda s, d: P.by_pattern(trades(s, d), universe(s, d), 0.5, HOLD).select("pattern_type", "observations", r6("base_success_rate"), "selected_trades",
        r6("selected_success_rate"), r6("mean_selected_net_return", digits=13), r6("mean_run_net_return_points", digits=13)),
    f"""WITH RECURSIVE {BASE}, tp AS (SELECT * REPLACE (pattern_type || '|' || run_id AS run_id), run_id AS src FROM trades), {scored_sql([0.5], 'tp')},
    ex AS (SELECT sq.* FROM sq JOIN sr ON sr.run_id = sq.run_id AND sr.rn = sq.rn AND sr.acc), pt AS (SELECT DISTINCT pattern_type FROM trades),
    tot AS (SELECT pattern_type, src, sum(net_directional_return) AS t FROM ex GROUP BY 1, 2),
    un AS (SELECT pt.pattern_type, structure_id, avg(coalesce(t, 0)) AS u FROM pt CROSS JOIN runs LEFT JOIN tot ON tot.pattern_type = pt.pattern_type AND tot.src = runs.run_id GROUP BY 1, 2),
    mu AS (SELECT pattern_type, avg(u) AS m FROM un GROUP BY 1), b AS (SELECT pattern_type, count(*) AS n, avg(profitable) AS p FROM trades GROUP BY 1),
    e AS (SELECT pattern_type, count(*) AS n, avg(profitable) AS p, avg(net_directional_return) AS r FROM ex GROUP BY 1)
    SELECT b.pattern_type, b.n AS observations, round(b.p, 6) AS base_success_rate, coalesce(e.n, 0) AS selected_trades, round(e.p, 6) AS selected_success_rate,
      round(e.r, 13) AS mean_selected_net_return, round(m, 13) AS mean_run_net_return_points FROM b JOIN mu ON mu.pattern_type = b.pattern_type LEFT JOIN e ON e.pattern_type = b.pattern_type""",
)


def featured(s, d) -> DataFrame:
    return with_structure(s, d).withColumns({
        "entry_rank": F.col("entry_index").cast("double"), "hold": (F.col("exit_index") - F.col("entry_index")).cast("double"),
        "score": F.col("probability")})


COND_F = ["entry_rank", "hold", "score"]
COND = ["mean_feature_value", "success_rate_event_weighted", "net_return_event_weighted", "probability_event_weighted", "mean_run_success_rate",
        "success_ci_low", "success_ci_high", "mean_run_net_return", "net_ci_low", "net_ci_high", "mean_run_probability"]
_plo, _phi = ci_columns("st", "mp", "dp", "p")
_rlo, _rhi = ci_columns("st", "mr", "dr", "r")
add(
    "AGG20_condition_response",
    lambda s, d: P.condition_response(featured(s, d), COND_F).select(
        "pattern_scope", "feature", F.col("condition_bin").cast("long").alias("condition_bin"), "observations", "runs", "structures", *[r6(c) for c in COND]),
    f"""WITH {BASE}, fx AS (SELECT t.*, structure_id, CAST(entry_index AS DOUBLE) AS entry_rank, CAST(exit_index - entry_index AS DOUBLE) AS hold, probability AS score FROM trades t JOIN runs ON runs.run_id = t.run_id),
    lg AS ({" UNION ALL ".join(f"SELECT run_id, structure_id, profitable, net_directional_return, probability, {sc} AS pattern_scope, '{f}' AS feature, {f} AS value FROM fx" for f in COND_F for sc in ("'__all_patterns__'", "pattern_type"))}),
    eg AS (SELECT pattern_scope, feature, quantile_cont(value, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM lg GROUP BY 1, 2
      HAVING count(*) >= CASE WHEN pattern_scope = '__all_patterns__' THEN 20 ELSE 30 END AND count(DISTINCT value) >= 3),
    bn AS (SELECT lg.*, greatest(1, len(list_filter(list_distinct(e), lambda z: z < value))) AS condition_bin FROM lg JOIN eg ON eg.pattern_scope = lg.pattern_scope AND eg.feature = lg.feature),
    r1 AS (SELECT pattern_scope, feature, condition_bin, structure_id, run_id, avg(profitable) AS p, avg(net_directional_return) AS r, avg(probability) AS q FROM bn GROUP BY ALL),
    s1 AS (SELECT pattern_scope, feature, condition_bin, structure_id, avg(p) AS p, avg(r) AS r, avg(q) AS q, count(*) AS nr FROM r1 GROUP BY ALL),
    g1 AS (SELECT pattern_scope, feature, condition_bin, count(*) AS st, CAST(sum(nr) AS BIGINT) AS runs, avg(p) AS mp, stddev_samp(p) AS dp, avg(r) AS mr, stddev_samp(r) AS dr, avg(q) AS mq FROM s1 GROUP BY ALL),
    e1 AS (SELECT pattern_scope, feature, condition_bin, count(*) AS n, avg(value) AS v, avg(profitable) AS p, avg(net_directional_return) AS r, avg(probability) AS q FROM bn GROUP BY ALL)
    SELECT g1.pattern_scope, g1.feature, g1.condition_bin, n AS observations, runs, st AS structures, round(v, 6) AS mean_feature_value, round(p, 6) AS success_rate_event_weighted,
      round(r, 6) AS net_return_event_weighted, round(q, 6) AS probability_event_weighted, round(mp, 6) AS mean_run_success_rate, round({_plo}, 6) AS success_ci_low, round({_phi}, 6) AS success_ci_high,
      round(mr, 6) AS mean_run_net_return, round({_rlo}, 6) AS net_ci_low, round({_rhi}, 6) AS net_ci_high, round(mq, 6) AS mean_run_probability
    FROM g1 JOIN e1 ON e1.pattern_scope = g1.pattern_scope AND e1.feature = g1.feature AND e1.condition_bin = g1.condition_bin
      LEFT JOIN tcrit tc_p ON tc_p.df = st - 1 LEFT JOIN tcrit tc_r ON tc_r.df = st - 1""",
)
add(
    "AGG21_dataset_diagnostics",
    lambda s, d: P.dataset_diagnostics(with_structure(s, d)).select(
        F.coalesce("pattern_type", F.lit("*")).alias("pattern_type"), F.coalesce("world_family", F.lit("*")).alias("world_family"),
        "observations", "structures", "runs", r6("success_rate"), r6("mean_net_return", digits=13)),
    f"""WITH {BASE}, j AS (SELECT * FROM trades JOIN runs USING (run_id)) SELECT coalesce(pattern_type, '*') AS pattern_type, coalesce(world_family, '*') AS world_family, count(*) AS observations,
    count(DISTINCT structure_id) AS structures, count(DISTINCT run_id) AS runs, round(avg(profitable), 6) AS success_rate, round(avg(net_directional_return), 13) AS mean_net_return
    FROM j GROUP BY GROUPING SETS ((pattern_type), (world_family), ())""",
)
add(
    "AGG21_run_coverage",
    lambda s, d: P.run_coverage(universe(s, d), trades(s, d)).select("world_family", "generated_runs", "structures", "runs_with_patterns", r6("pattern_run_fraction")),
    f"""WITH {BASE} SELECT world_family, count(*) AS generated_runs, count(DISTINCT structure_id) AS structures, count(h.run_id) AS runs_with_patterns,
    round(count(h.run_id) / count(*)::DOUBLE, 6) AS pattern_run_fraction FROM runs LEFT JOIN (SELECT DISTINCT run_id FROM trades) h ON h.run_id = runs.run_id GROUP BY 1""",
)

SUMMARY = ["steps", "final_trade_price", "average_spread", "average_spread_fraction", "realized_volatility_per_step", "mean_log_return_per_step",
           "return_lag1_autocorrelation", "return_skewness", "return_excess_kurtosis", "max_drawdown", "buy_volume", "sell_volume", "signed_order_flow",
           "total_volume", "trade_count", "price_value_log_rmse", "amihud_like_illiquidity"]


def path_summary(s, d) -> DataFrame:
    """Statistics of each tick path: returns, spread, flow, drawdown, illiquidity, distance to value."""
    t = V.event_ticks(s, d).withColumn("value_ref", F.lit(100.0))
    x = T.lag_pairs(t.select("run_id", "step", "walk", "bid", "ask", "buy_volume", "sell_volume", "trade_count", "volume", "value_ref"), "walk", "step", positive=False)
    m = T.moments()
    g = x.groupBy("run_id").agg(
        F.count(F.lit(1)).cast("double").alias("steps"), F.max_by("walk", "step").alias("final_trade_price"),
        F.avg(F.col("ask") - F.col("bid")).alias("average_spread"), F.avg(divide(F.col("ask") - F.col("bid"), F.col("walk"))).alias("average_spread_fraction"),
        F.stddev_pop("ret").alias("realized_volatility_per_step"), F.avg("ret").alias("mean_log_return_per_step"),
        T.lag1_autocorrelation().alias("return_lag1_autocorrelation"), *[v.alias(k) for k, v in m.items()],
        F.sum("buy_volume").cast("double").alias("buy_volume"), F.sum("sell_volume").cast("double").alias("sell_volume"),
        F.sum(F.col("buy_volume") - F.col("sell_volume")).cast("double").alias("signed_order_flow"), F.sum("volume").cast("double").alias("total_volume"),
        F.sum("trade_count").cast("double").alias("trade_count"),
        F.sqrt(F.avg(F.pow(ln(F.col("walk") / F.col("value_ref")), 2))).alias("price_value_log_rmse"),
        F.avg(F.abs("ret") / F.col("volume")).alias("amihud_like_illiquidity"))
    fall = P.run_drawdown(x.withColumn("pnl", F.coalesce("ret", F.lit(0.0))), ["run_id"], "pnl", "step")
    return g.join(fall, "run_id")


SUM_SQL = f"""{S.TICKS}, q0 AS (SELECT *, ln(walk) - ln(lag(walk) OVER (PARTITION BY run_id ORDER BY step)) AS ret FROM ticks),
q1 AS (SELECT *, lag(ret) OVER (PARTITION BY run_id ORDER BY step) AS pr, sum(coalesce(ret, 0)) OVER (PARTITION BY run_id ORDER BY step) AS cum FROM q0),
q2 AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY run_id ORDER BY step)) - cum AS fall, avg(ret) OVER (PARTITION BY run_id) AS mu, stddev_pop(ret) OVER (PARTITION BY run_id) AS sd FROM q1),
ps AS (SELECT run_id, count(*)::DOUBLE AS steps, arg_max(walk, step) AS final_trade_price, avg(ask - bid) AS average_spread, avg((ask - bid) / walk) AS average_spread_fraction,
  stddev_pop(ret) AS realized_volatility_per_step, avg(ret) AS mean_log_return_per_step, corr(pr, ret) AS return_lag1_autocorrelation, avg(power((ret - mu) / sd, 3)) AS return_skewness,
  avg(power((ret - mu) / sd, 4)) - 3 AS return_excess_kurtosis, max(fall) AS max_drawdown, sum(buy_volume)::DOUBLE AS buy_volume, sum(sell_volume)::DOUBLE AS sell_volume,
  sum(buy_volume - sell_volume)::DOUBLE AS signed_order_flow, sum(volume)::DOUBLE AS total_volume, sum(trade_count)::DOUBLE AS trade_count, sqrt(avg(power(ln(walk / 100.0::DOUBLE), 2))) AS price_value_log_rmse,
  avg(abs(ret) / volume) AS amihud_like_illiquidity FROM q2 GROUP BY 1)"""
add("AGG22_path_summary", lambda s, d: path_summary(s, d).select("run_id", *[r6(c) for c in SUMMARY]),
    f"WITH {SUM_SQL} SELECT run_id, {S.pick(SUMMARY)} FROM ps")
add("AGG23_across_run_summary",
    lambda s, d: P.across_runs(path_summary(s, d), SUMMARY).select("statistic", "runs", r6("mean"), r6("sd")),
    f"WITH {SUM_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS statistic, count({c}) AS runs, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS sd FROM ps" for c in SUMMARY))
add(
    "AGG24_mergeable_moments",
    lambda s, d: P.unit_interval(trades(s, d).withColumnRenamed("net_directional_return", "unit"), ["pattern_type"]).select(
        "pattern_type", F.col("inference_structures").alias("n"), r6("mean", F.col("mean_unit"), 9)),
    f"WITH {S.ORDER_TRADES} SELECT pattern_type, count(*) AS n, round(avg(net_directional_return), 9) AS mean FROM trades GROUP BY 1",
)
add(
    "AGG24_moments_and_p_value",
    lambda s, d: P.unit_interval(with_structure(s, d).groupBy("pattern_type", "structure_id").agg(F.avg("net_directional_return").alias("unit")), ["pattern_type"]).select(
        "pattern_type", F.col("inference_structures").alias("n"), r6("mean", F.col("mean_unit"), 13), r6("ci_low", digits=13), r6("ci_high", digits=13), r6("p_value")),
    f"""WITH {BASE}, u AS (SELECT pattern_type, structure_id, avg(net_directional_return) AS unit FROM trades JOIN runs USING (run_id) GROUP BY 1, 2),
    a AS (SELECT pattern_type, count(*) AS n, avg(unit) AS m, stddev_samp(unit) AS sd FROM u GROUP BY 1)
    SELECT pattern_type, n, round(m, 13) AS mean, round({_lo}, 13) AS ci_low, round({_hi}, 13) AS ci_high, round({p_expr('n', 'm', 'sd')}, 6) AS p_value FROM a LEFT JOIN tcrit tc_x ON tc_x.df = n - 1""",
)
add(
    "AGG25_economics_many_thresholds",
    lambda s, d: P.economic_metrics(trades(s, d), universe(s, d), THRESHOLDS, HOLD).select(r6("threshold"), *E_INT, *[r6(c, digits=13) for c in E_REAL]),
    f"WITH RECURSIVE {BASE}, {econ_sql(THRESHOLDS)} SELECT round(threshold, 6) AS threshold, {', '.join(E_INT)}, {S.pick(E_REAL, 13)} FROM ec",
)
add(
    "AGG26_counts_by_structure",
    lambda s, d: with_structure(s, d).groupBy("structure_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("run_id").alias("runs"),
                                                                 F.count_distinct("pattern_type").alias("patterns")),
    f"WITH {BASE} SELECT structure_id, count(*) AS rows, count(DISTINCT run_id) AS runs, count(DISTINCT pattern_type) AS patterns FROM trades JOIN runs USING (run_id) GROUP BY 1",
)

# --- CLS ---------------------------------------------------------------------------------------------


def scores(s, d) -> DataFrame:
    return V.event_scores(s, d)


RANK_SQL = f"""{S.SCORES}, g AS (SELECT probability, sum(label) AS pos, count(*) AS n FROM scores GROUP BY 1),
c AS (SELECT *, sum(pos) OVER (ORDER BY probability DESC) AS tp, sum(n) OVER (ORDER BY probability DESC) AS seen FROM g), t AS (SELECT sum(pos) AS p, sum(n - pos) AS q FROM g)"""
add("CLS1_exact_roc_auc", lambda s, d: C.ranking_metrics(scores(s, d)).select(r6("roc_auc", digits=8)),
    f"""WITH {S.SCORES}, rk AS (SELECT label, rank() OVER (ORDER BY probability) + (count(*) OVER (PARTITION BY probability) - 1) / 2.0::DOUBLE AS r FROM scores)
    SELECT round((sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label) * (count(*) - sum(label)))::DOUBLE, 8) AS roc_auc FROM rk""")
add("CLS2_exact_average_precision", lambda s, d: C.ranking_metrics(scores(s, d)).select(r6("average_precision", digits=8)),
    f"WITH {RANK_SQL} SELECT round(CAST(sum(pos * tp / seen::DOUBLE) AS DOUBLE) / max(p), 8) AS average_precision FROM c, t")
HIST_SQL = f"""{S.SCORES}, h AS (SELECT least(floor(probability * 4096), 4095) AS b, sum(label) AS pos, count(*) AS n FROM scores GROUP BY 1),
c AS (SELECT *, sum(pos) OVER (ORDER BY b DESC) AS tp, sum(n) OVER (ORDER BY b DESC) AS seen, sum(n - pos) OVER (ORDER BY b) - (n - pos) AS nb FROM h), t AS (SELECT sum(pos) AS p, sum(n - pos) AS q FROM h)"""
add("CLS3_histogram_ranking", lambda s, d: C.histogram_ranking(scores(s, d)).select(r6("roc_auc", digits=8), r6("average_precision", digits=8)),
    f"WITH {HIST_SQL} SELECT round(CAST(sum(pos * (nb + (n - pos) * 0.5::DOUBLE)) AS DOUBLE) / max(p) / max(q), 8) AS roc_auc, round(CAST(sum(pos * tp / seen::DOUBLE) AS DOUBLE) / max(p), 8) AS average_precision FROM c, t")
add(
    "CLS4_threshold_metrics",
    lambda s, d: C.threshold_metrics(labelled(s, d), 0.5, ["pattern_type"]).select("pattern_type", *[r6(c) for c in (
        "brier_score", "accuracy_at_threshold", "precision_at_threshold", "recall_at_threshold")]),
    f"""WITH {S.ORDER_TRADES} SELECT pattern_type, round(avg(power(probability - profitable, 2)), 6) AS brier_score,
    round(avg(CASE WHEN (probability >= 0.5) = (profitable = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy_at_threshold,
    round(count(*) FILTER (probability >= 0.5 AND profitable = 1) / greatest(1, count(*) FILTER (probability >= 0.5))::DOUBLE, 6) AS precision_at_threshold,
    round(count(*) FILTER (probability >= 0.5 AND profitable = 1) / greatest(1, count(*) FILTER (profitable = 1))::DOUBLE, 6) AS recall_at_threshold FROM trades GROUP BY 1""",
)
_edges = ", ".join(f"{i * 0.1!r}::DOUBLE" for i in range(1, 10))
CAL_SQL = f"""{S.SCORES}, b AS (SELECT *, len(list_filter([{_edges}], lambda e: e <= probability)) AS bin FROM scores)"""
add("CLS5_expected_calibration_error", lambda s, d: C.calibration_error(scores(s, d)).select(r6("expected_calibration_error", digits=8)),
    f"WITH {CAL_SQL}, g AS (SELECT bin, avg(label) AS y, avg(probability) AS p, count(*) AS n FROM b GROUP BY 1) SELECT round(sum(n * abs(y - p)) / sum(n), 8) AS expected_calibration_error FROM g")
add("CLS6_quantile_calibration",
    lambda s, d: C.quantile_calibration(scores(s, d)).select(F.col("bin").cast("long").alias("bin"), "count", r6("mean_predicted_probability"), r6("observed_success_rate")),
    f"""WITH {S.SCORES}, e AS (SELECT quantile_cont(probability, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM scores),
    b AS (SELECT scores.*, len(list_filter(e, lambda z: z < probability)) AS bin FROM scores, e)
    SELECT bin, count(*) AS count, round(avg(probability), 6) AS mean_predicted_probability, round(avg(label), 6) AS observed_success_rate FROM b GROUP BY 1""")
add("CLS7_fixed_bin_calibration",
    lambda s, d: C.calibration_table(scores(s, d)).select(r6("bin_lower"), r6("bin_upper"), "count", r6("mean_probability"), r6("observed_success_rate")),
    f"WITH {CAL_SQL} SELECT round(bin / 10.0::DOUBLE, 6) AS bin_lower, round((bin + 1) / 10.0::DOUBLE, 6) AS bin_upper, count(*) AS count, round(avg(probability), 6) AS mean_probability, round(avg(label), 6) AS observed_success_rate FROM b GROUP BY bin")
add("CLS8_log_loss", lambda s, d: C.log_loss(scores(s, d)).select(r6("log_loss", digits=8)),
    f"""WITH {S.SCORES}, p AS (SELECT label, least(greatest(probability, 1e-15), 1 - 1e-15) AS q FROM scores)
    SELECT round(avg(-CASE WHEN label = 1 THEN ln(q) ELSE ln(1 - q) END), 8) AS log_loss FROM p""")
GRID = ExperimentConfig().thresholds()


def threshold_grid(s, d):
    """Candidates at every step of the threshold grid (integer steps, never above the maximum)."""
    cfg = ExperimentConfig()
    n = len(cfg.thresholds())
    step = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    t = F.least(F.lit(cfg.threshold_max), F.lit(cfg.threshold_min) + F.col("i") * cfg.threshold_step)
    x = trades(s, d).select("probability", step.alias("i")).withColumn("threshold", t)
    return x.groupBy("i", "threshold").agg(F.count(F.when(F.col("probability") >= F.col("threshold"), 1)).alias("candidates")).select(
        F.col("i").cast("long").alias("i"), r6("threshold"), "candidates")


add("CLS9_threshold_grid", threshold_grid,
    f"""WITH {S.ORDER_TRADES} SELECT i, round(least(0.9::DOUBLE, 0.5::DOUBLE + i * 0.025::DOUBLE), 6) AS threshold,
    count(*) FILTER (probability >= least(0.9::DOUBLE, 0.5::DOUBLE + i * 0.025::DOUBLE)) AS candidates FROM trades, range(17) r(i) GROUP BY 1, 2""")
add("CLS10_threshold_choice",
    lambda s, d: C.choose_threshold(P.economic_metrics(trades(s, d), universe(s, d), THRESHOLDS, HOLD), 25, 5).select(
        r6("threshold"), "selected_trades", "selected_runs", r6("mean_run_net_return_points", digits=13)),
    f"""WITH RECURSIVE {BASE}, {econ_sql(THRESHOLDS)} SELECT round(threshold, 6) AS threshold, selected_trades, selected_runs, round(mean_run_net_return_points, 13) AS mean_run_net_return_points
    FROM ec WHERE selected_trades >= 25 AND selected_runs >= 5 ORDER BY ec.mean_run_net_return_points DESC, selected_runs DESC, ec.threshold LIMIT 1""")
add("CLS11_validation_metrics_row",
    lambda s, d: C.classification_metrics(labelled(s, d), 0.5).withColumnsRenamed({c: f"validation_{c}" for c in (
        "roc_auc", "average_precision", "brier_score", "expected_calibration_error")}).select(
        *[r6(f"validation_{c}") for c in ("roc_auc", "average_precision", "brier_score", "expected_calibration_error")]),
    f"""WITH {S.ORDER_TRADES}, rk AS (SELECT profitable AS label, probability, rank() OVER (ORDER BY probability) + (count(*) OVER (PARTITION BY probability) - 1) / 2.0::DOUBLE AS r FROM trades),
    g AS (SELECT probability, sum(profitable) AS pos, count(*) AS n FROM trades GROUP BY 1), c AS (SELECT *, sum(pos) OVER (ORDER BY probability DESC) AS tp, sum(n) OVER (ORDER BY probability DESC) AS seen FROM g),
    b AS (SELECT len(list_filter([{_edges}], lambda e: e <= probability)) AS bin, avg(profitable) AS y, avg(probability) AS p, count(*) AS n FROM trades GROUP BY 1)
    SELECT (SELECT round((sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label) * (count(*) - sum(label)))::DOUBLE, 6) FROM rk) AS validation_roc_auc,
      (SELECT round(CAST(sum(pos * tp / seen::DOUBLE) AS DOUBLE) / sum(pos), 6) FROM c) AS validation_average_precision, (SELECT round(avg(power(probability - profitable, 2)), 6) FROM trades) AS validation_brier_score,
      (SELECT round(sum(n * abs(y - p)) / sum(n), 6) FROM b) AS validation_expected_calibration_error""")


def model_rows(s, d):
    """Three scorers of the same rows: the table's score, its square and a blend with a constant."""
    base = labelled(s, d)
    forms = {"plain": F.col("probability"), "squared": F.col("probability") * F.col("probability"), "shrunk": 0.5 + 0.5 * (F.col("probability") - 0.5)}
    return base.withColumn("m", F.explode(F.array(*[F.struct(F.lit(k).alias("model"), v.alias("p")) for k, v in forms.items()]))).select(
        "*", "m.model", F.col("m.p").alias("p2")).drop("m", "probability").withColumnRenamed("p2", "probability")


def primary(s, d):
    x = model_rows(s, d)
    cmp = C.ranking_metrics(x, ["model"]).join(C.threshold_metrics(x, 0.5, ["model"]), "model").join(
        x.groupBy("model").agg(F.avg("net_directional_return").alias("validation_mean_run_net_return_points"), F.avg("probability").alias("uplift_p_value")), "model")
    cmp = cmp.withColumnsRenamed({"roc_auc": "validation_roc_auc", "brier_score": "validation_brier_score"})
    return C.choose_primary(cmp).select("model", r6("validation_brier_score", digits=7), "primary_model", r6("confirmatory_p_value"))


add("CLS12_primary_model", primary,
    f"""WITH {S.ORDER_TRADES}, x AS (SELECT 'plain' AS model, probability AS p, profitable AS y FROM trades UNION ALL SELECT 'squared', probability * probability, profitable FROM trades
      UNION ALL SELECT 'shrunk', 0.5::DOUBLE + 0.5::DOUBLE * (probability - 0.5::DOUBLE), profitable FROM trades),
    r AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0::DOUBLE AS r FROM x),
    m AS (SELECT model, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y)))::DOUBLE AS auc, avg(power(p - y, 2)) AS br, avg(p) AS pv FROM r GROUP BY 1),
    k AS (SELECT *, row_number() OVER (ORDER BY auc DESC, br, model) = 1 AS primary_model FROM m)
    SELECT model, round(br, 7) AS validation_brier_score, primary_model, round(CASE WHEN primary_model THEN least(1, 2 * pv) END, 6) AS confirmatory_p_value FROM k""")
add("CLS13_scorer_comparison",
    lambda s, d: C.compare_scorers(scores(s, d).withColumns({"a": F.col("probability"), "b": F.least(F.lit(1.0), F.col("probability") * 1.05 + 0.001)}), "a", "b").select(
        r6("probability_mae", digits=8), r6("log_loss_difference", digits=7), r6("brier_difference", digits=8), r6("ece_difference", digits=8), "accepted"),
    f"""WITH {S.SCORES}, x AS (SELECT label AS y, probability AS a, least(1.0::DOUBLE, probability * 1.05::DOUBLE + 0.001::DOUBLE) AS b FROM scores),
    l AS (SELECT y, a, b, least(greatest(a, 1e-15), 1 - 1e-15) AS ca, least(greatest(b, 1e-15), 1 - 1e-15) AS cb, len(list_filter([{_edges}], lambda e: e <= a)) AS ba, len(list_filter([{_edges}], lambda e: e <= b)) AS bb FROM x),
    ea AS (SELECT sum(abs(z)) / max(n) AS e FROM (SELECT ba, sum(y) - sum(a) AS z, sum(count(*)) OVER () AS n FROM l GROUP BY 1)), eb AS (SELECT sum(abs(z)) / max(n) AS e FROM (SELECT bb, sum(y) - sum(b) AS z, sum(count(*)) OVER () AS n FROM l GROUP BY 1)),
    o AS (SELECT avg(abs(a - b)) AS mae, avg(-CASE WHEN y = 1 THEN ln(cb) ELSE ln(1 - cb) END) - avg(-CASE WHEN y = 1 THEN ln(ca) ELSE ln(1 - ca) END) AS ll, avg(power(b - y, 2)) - avg(power(a - y, 2)) AS br FROM l)
    SELECT round(mae, 8) AS probability_mae, round(ll, 7) AS log_loss_difference, round(br, 8) AS brier_difference, round(eb.e - ea.e, 8) AS ece_difference,
      mae < 0.05 AND ll < 0.02 AND br < 0.01 AND eb.e - ea.e < 0.03 AS accepted FROM o, ea, eb""")
