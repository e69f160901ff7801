"""TRD and NUL rows, and the inference rows that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from candlemill.catalog import sql as S
from candlemill.catalog.bars_and_features import r6
from candlemill.catalog.registry import add
from candlemill.catalog.tdist_sql import ci_columns, critical_cte, p_expr
from candlemill.config import PATTERN_NAMES, ProcedureConfig
from candlemill.operators import controls as N, features as T, inference as I, overlap as O, trades as X
from candlemill.operators.signals import signal_events
from candlemill.sources import views as V
from candlemill.sources.series import sorted_join, stored

HORIZONS = (1, 3, 5, 10, 20)
PROC = ProcedureConfig(horizons=(5, 10), controls_per_event=8, min_controls=5, min_events=5, min_seeds=2)
MIN_ENTRY = 43  # observation length 43, delay 1


def events(s: SparkSession, d: str) -> DataFrame:
    e = stored(s, ("signal_events", d), lambda: signal_events(V.lineitem_bars(s, d)))
    return e.withColumn("direction", X.trade_direction(F.col("breakout_confirmed"), F.col("breakout_direction")))


def bar_counts(s, d) -> DataFrame:
    return V.lineitem_bars(s, d).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_bars"))


def proc_trades(s, d) -> DataFrame:
    return stored(s, ("trades", d), lambda: trades(s, d, horizons=PROC.horizons))


def trades(s, d, policy="skip_new", horizons=HORIZONS) -> DataFrame:
    return O.overlap_filter(X.with_portfolio(events(s, d)), bar_counts(s, d), horizons, policy)


def outcomes(s, d, horizons) -> DataFrame:
    return X.horizon_outcomes(V.lineitem_bars(s, d), horizons)


def states(s, d) -> DataFrame:
    return stored(s, ("states", d), lambda: _states(s, d))


def _states(s, d) -> DataFrame:
    bars = V.lineitem_bars(s, d).select("run_id", "bar_index", "close", "entry_spread")
    return T.trailing_volatility(bars, PROC.volatility_lookback).drop("close")


W = "PARTITION BY run_id ORDER BY bar_index"
EV_SQL = f"""{S.LI},
sx AS (SELECT run_id, bar_index, close, max(close) OVER ({W} ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING) AS hi,
   min(close) OVER ({W} ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING) AS lo,
   CASE WHEN bar_index >= 23 THEN (close - avg(close) OVER ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)) /
     nullif(stddev_pop(close) OVER ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 0) END AS z FROM bars),
se AS (
 SELECT run_id, bar_index, 'rectangle' AS pattern_name, true AS breakout_confirmed, CASE WHEN close > hi THEN 'bullish' ELSE 'bearish' END AS side,
   round(least(1.0, CASE WHEN close > hi THEN close / hi - 1 ELSE 1 - close / lo END), 4) AS fit FROM sx WHERE bar_index >= 120 AND (close > hi OR close < lo)
 UNION ALL SELECT run_id, bar_index, 'double_top', z > 4.0, CASE WHEN z > 4.0 THEN 'bearish' END, round(least(1.0, z / 5), 4) FROM sx WHERE z > 3.2
 UNION ALL SELECT run_id, bar_index, 'double_bottom', true, 'bullish', round(least(1.0, -z / 5), 4) FROM sx WHERE z < -1.2),
ev AS (SELECT run_id, 'EV-' || run_id || '-' || bar_index || '-' || pattern_name AS event_id, pattern_name, bar_index AS available_at_index,
   bar_index - 20 AS start_index, bar_index - 2 AS end_index, 43 AS obs, 35 AS core, fit, breakout_confirmed, side,
   bar_index + 1 AS entry_index, CASE WHEN breakout_confirmed AND side = 'bullish' THEN 1 WHEN breakout_confirmed AND side = 'bearish' THEN -1 END AS direction FROM se),
nb AS (SELECT run_id, count(*) AS n_bars FROM bars GROUP BY 1)"""

FAMILY = "CASE pattern_name " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(PATTERN_NAMES)) + " ELSE 7 END"


def plan_sql(horizons=HORIZONS) -> str:
    hv = ", ".join(f"({h})" for h in horizons)
    return f"""{EV_SQL},
hyp AS (SELECT *, pattern_name AS hypothesis FROM ev UNION ALL SELECT *, '__all_patterns__' FROM ev),
plan AS (SELECT hyp.*, horizon, entry_index + horizon - 1 AS exit_index,
   coalesce(direction IS NOT NULL AND entry_index + horizon - 1 < n_bars, false) AS ok
   FROM hyp JOIN nb USING (run_id), (VALUES {hv}) hz(horizon)),
good AS (SELECT *, min(direction) OVER g <> max(direction) OVER g AS conflict,
   row_number() OVER (PARTITION BY run_id, hypothesis, horizon, entry_index ORDER BY {FAMILY}, pattern_name, available_at_index, start_index, end_index, obs, core, -fit, event_id) AS rk
   FROM plan WHERE ok WINDOW g AS (PARTITION BY run_id, hypothesis, horizon, entry_index)),
seq AS (SELECT *, row_number() OVER (PARTITION BY run_id, hypothesis, horizon ORDER BY entry_index) AS rn FROM good WHERE NOT conflict AND rk = 1),
rec AS (SELECT run_id, hypothesis, horizon, rn, event_id, exit_index AS open_until, true AS acc FROM seq WHERE rn = 1
  UNION ALL SELECT q.run_id, q.hypothesis, q.horizon, q.rn, q.event_id, CASE WHEN q.entry_index > r.open_until THEN q.exit_index ELSE r.open_until END, q.entry_index > r.open_until
  FROM rec r JOIN seq q ON q.run_id = r.run_id AND q.hypothesis = r.hypothesis AND q.horizon = r.horizon AND q.rn = r.rn + 1),
tr AS (SELECT p.*, CASE WHEN NOT p.ok THEN 'untradeable' WHEN rec.acc THEN 'accepted' ELSE 'skipped' END AS status
  FROM plan p LEFT JOIN rec ON p.run_id = rec.run_id AND p.hypothesis = rec.hypothesis AND p.horizon = rec.horizon AND p.event_id = rec.event_id)"""


def out_sql(horizons) -> str:
    ahead = " UNION ALL ".join(
        f"SELECT run_id, bar_index AS entry_index, {h} AS horizon, entry_mid AS em, lead(exit_mid, {h - 1}) OVER w AS xm, entry_spread / 2 AS eh, "
        f"lead(exit_spread, {h - 1}) OVER w / 2 AS xh, lead(bar_index, {h - 1}) OVER w AS xi FROM bars WINDOW w AS (PARTITION BY run_id ORDER BY bar_index)" for h in horizons)
    return f"""oc0 AS (SELECT e.*, direction FROM ({ahead}) e, (VALUES (-1), (1)) dv(direction) WHERE xi = entry_index + horizon - 1),
oc1 AS (SELECT *, CASE WHEN direction = 1 THEN em * (1 + eh) ELSE em * (1 - eh) END AS fin, CASE WHEN direction = 1 THEN xm * (1 - xh) ELSE xm * (1 + xh) END AS fout FROM oc0),
oc AS (SELECT run_id, entry_index, horizon, direction, direction * (xm - em) / em AS gross_return,
   direction * (xm - em) / em - direction * (fout - fin) / em AS spread_slippage_cost, 0.0001 * (fin + fout) / em AS brokerage_cost,
   direction * (xm - em) / em - direction * (fout - fin) / em + 0.0001 * (fin + fout) / em AS total_transaction_cost,
   direction * (fout - fin) / em - 0.0001 * (fin + fout) / em AS net_return FROM oc1)"""


RET = ["gross_return", "spread_slippage_cost", "brokerage_cost", "total_transaction_cost", "net_return"]

add(
    "TRD1_breakout_direction",
    lambda s, d: events(s, d).select("run_id", "event_id", F.col("direction").cast("long").alias("direction")),
    f"WITH {EV_SQL} SELECT run_id, event_id, direction FROM ev",
)
add(
    "TRD2_round_trip_costs",
    lambda s, d: X.horizon_outcomes(V.lineitem_bars(s, d), [1]).select(
        "run_id", "entry_index", F.col("direction").cast("long").alias("direction"), *[r6(c) for c in RET]),
    f"WITH {S.LI}, {out_sql((1,))} SELECT run_id, entry_index, direction, {S.pick(RET)} FROM oc",
)
add(
    "TRD3_horizon_returns",
    lambda s, d: outcomes(s, d, HORIZONS).groupBy("run_id", "horizon", "direction").agg(
        F.count(F.lit(1)).alias("entries"), F.max("entry_index").alias("last_entry"), r6("gross_sum", F.sum("gross_return")),
        r6("net_min", F.min("net_return")), r6("net_max", F.max("net_return")), r6("cost_sum", F.sum("total_transaction_cost")))
    .withColumns({"horizon": F.col("horizon").cast("long"), "direction": F.col("direction").cast("long")}),
    f"""WITH {S.LI}, {out_sql(HORIZONS)} SELECT run_id, horizon, direction, count(*) AS entries, max(entry_index) AS last_entry, round(sum(gross_return), 6) AS gross_sum,
    round(min(net_return), 6) AS net_min, round(max(net_return), 6) AS net_max, round(sum(total_transaction_cost), 6) AS cost_sum FROM oc GROUP BY 1, 2, 3""",
)


def _status(policy):
    return lambda s, d: trades(s, d, policy).select(
        "run_id", "hypothesis", F.col("horizon").cast("long").alias("horizon"), "event_id", "entry_index", "exit_index", "status")


add("TRD4_overlap_skip_new", _status("skip_new"),
    f"WITH RECURSIVE {plan_sql()} SELECT run_id, hypothesis, horizon, event_id, entry_index, exit_index, status FROM tr")
add("TRD4_overlap_allow", _status("allow"),
    f"""WITH {plan_sql().split('seq AS')[0].rstrip().rstrip(',')} SELECT p.run_id, p.hypothesis, p.horizon, p.event_id, p.entry_index, p.exit_index,
    CASE WHEN NOT p.ok THEN 'untradeable' WHEN NOT g.conflict AND g.rk = 1 THEN 'accepted' ELSE 'skipped' END AS status
    FROM plan p LEFT JOIN good g ON p.run_id = g.run_id AND p.hypothesis = g.hypothesis AND p.horizon = g.horizon AND p.event_id = g.event_id""")

# Scored trades on orders
PFAM = FAMILY.replace("pattern_name", "pattern_type")
THRESHOLDS = [0.5 + 0.05 * i for i in range(9)]


def scored_sql(thresholds, source="trades") -> str:
    tv = ", ".join(f"({t!r}::DOUBLE)" for t in thresholds)
    return f"""sc AS (SELECT t.*, threshold FROM {source} t, (VALUES {tv}) th(threshold) WHERE probability >= threshold),
st AS (SELECT *, abs(probability - max(probability) OVER (PARTITION BY run_id, threshold, entry_index)) <= 1e-12 AS tied FROM sc),
su AS (SELECT *, count(DISTINCT CASE WHEN tied THEN trade_direction END) OVER (PARTITION BY run_id, threshold, entry_index) AS sides,
  row_number() OVER (PARTITION BY run_id, threshold, entry_index ORDER BY tied DESC, {PFAM}, pattern_type, row_id) AS rk FROM st),
sq AS (SELECT *, row_number() OVER (PARTITION BY run_id, threshold ORDER BY entry_index) AS rn FROM su WHERE tied AND sides = 1 AND rk = 1),
sr AS (SELECT run_id, threshold, rn, row_id, exit_index AS open_until, true AS acc FROM sq WHERE rn = 1
  UNION ALL SELECT q.run_id, q.threshold, q.rn, q.row_id, CASE WHEN q.entry_index > r.open_until THEN q.exit_index ELSE r.open_until END, q.entry_index > r.open_until
  FROM sr r JOIN sq q ON q.run_id = r.run_id AND q.threshold = r.threshold AND q.rn = r.rn + 1)"""


add(
    "TRD5_scored_same_entry",
    lambda s, d: O.resolve_scored_entry(V.order_trades(s, d), ["run_id"]).filter("_winner").select("run_id", "entry_index", "row_id"),
    f"WITH {S.ORDER_TRADES}, {scored_sql([0.0]).split('sr AS')[0].rstrip().rstrip(',')} SELECT run_id, entry_index, row_id FROM sq",
)
add(
    "TRD6_select_at_threshold",
    lambda s, d: O.select_trades(V.order_trades(s, d), [0.5], 3).filter("executed").select("run_id", "entry_index", "exit_index", "row_id"),
    f"WITH RECURSIVE {S.ORDER_TRADES}, {scored_sql([0.5])} SELECT run_id, entry_index, exit_index, row_id FROM trades WHERE row_id IN (SELECT row_id FROM sr WHERE acc)",
)
add(
    "TRD7_select_many_thresholds",
    lambda s, d: O.select_trades(V.order_trades(s, d), THRESHOLDS, 3).filter("executed").select("run_id", r6("threshold"), "row_id"),
    f"WITH RECURSIVE {S.ORDER_TRADES}, {scored_sql(THRESHOLDS)} SELECT run_id, round(threshold, 6) AS threshold, row_id FROM sr WHERE acc",
)
add(
    "TRD8_selection_masks",
    lambda s, d: O.selection_masks(V.order_trades(s, d), 0.6, 3).select(
        "row_id", F.col("candidate").cast("long").alias("candidate"), F.col("executed").cast("long").alias("executed")),
    f"""WITH RECURSIVE {S.ORDER_TRADES}, {scored_sql([0.6])} SELECT t.row_id, CASE WHEN probability >= 0.6::DOUBLE THEN 1 ELSE 0 END AS candidate,
    CASE WHEN a.row_id IS NOT NULL THEN 1 ELSE 0 END AS executed FROM trades t LEFT JOIN (SELECT row_id FROM sr WHERE acc) a ON a.row_id = t.row_id""",
)


def _excursions(s, d):
    e = events(s, d).filter(F.col("direction").isNotNull())
    x = X.excursions(V.lineitem_bars(s, d), 20).select("run_id", F.col("bar_index").alias("entry_index"), "entry_mid", "_hi", "_lo")
    j = sorted_join(e, x, ["run_id", "entry_index"])
    cols = X.excursion_columns(F.col("direction"), F.col("entry_mid"), F.col("_hi"), F.col("_lo"))
    return j.select("run_id", "event_id", *[r6(k, v) for k, v in cols.items()])


add(
    "TRD9_excursions", _excursions,
    f"""WITH {EV_SQL}, fx AS (SELECT run_id, bar_index, entry_mid, max(high) OVER f AS hi, min(low) OVER f AS lo, count(*) OVER f AS n FROM bars
      WINDOW f AS ({W} ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING))
    SELECT ev.run_id, event_id, round(greatest(0, CASE WHEN direction = 1 THEN hi / entry_mid - 1 ELSE 1 - lo / entry_mid END), 6) AS maximum_favorable_excursion,
      round(least(0, CASE WHEN direction = 1 THEN lo / entry_mid - 1 ELSE 1 - hi / entry_mid END), 6) AS maximum_adverse_excursion
    FROM ev JOIN fx ON fx.run_id = ev.run_id AND fx.bar_index = ev.entry_index WHERE direction IS NOT NULL AND n = 20""",
)
add(
    "TRD10_eligible_entries",
    lambda s, d: N.eligible_entries(V.lineitem_bars(s, d), bar_counts(s, d), HORIZONS, [43, 67, 96]).groupBy("run_id", "horizon", "min_entry").agg(
        F.count(F.lit(1)).alias("entries"), F.min("entry_index").alias("first_entry"), F.max("entry_index").alias("last_entry"))
    .withColumn("horizon", F.col("horizon").cast("long")),
    f"""WITH {S.LI}, nb AS (SELECT run_id, count(*) AS n FROM bars GROUP BY 1)
    SELECT run_id, horizon, min_entry, n - horizon - min_entry + 1 AS entries, min_entry AS first_entry, n - horizon AS last_entry
    FROM nb, (VALUES (1), (3), (5), (10), (20)) h(horizon), (VALUES (43), (67), (96)) m(min_entry) WHERE n - horizon >= min_entry""",
)
add(
    "TRD11_portfolio_label",
    lambda s, d: X.with_portfolio(events(s, d)).groupBy("run_id", "hypothesis").agg(F.count(F.lit(1)).alias("events"),
        F.count("direction").alias("directed")),
    f"""WITH {EV_SQL} SELECT run_id, pattern_name AS hypothesis, count(*) AS events, count(direction) AS directed FROM ev GROUP BY 1, 2
    UNION ALL SELECT run_id, '__all_patterns__', count(*), count(direction) FROM ev GROUP BY 1""",
)

# --- NUL ---------------------------------------------------------------------------------------
add(
    "NUL1_unconditional_baseline",
    lambda s, d: N.unconditional(outcomes(s, d, HORIZONS), [43, 67, 96]).select(
        "run_id", F.col("horizon").cast("long").alias("horizon"), F.col("direction").cast("long").alias("direction"), "min_entry", "eligible",
        r6("unconditional_mean_net_return"), r6("unconditional_hit_rate")),
    f"""WITH {S.LI}, {out_sql(HORIZONS)}, k AS (SELECT DISTINCT run_id, horizon, direction FROM oc)
    SELECT k.run_id, k.horizon, k.direction, m AS min_entry, count(oc.net_return) AS eligible, round(coalesce(avg(net_return), 0), 6) AS unconditional_mean_net_return,
      round(coalesce(avg(CASE WHEN gross_return > 0 THEN 1.0 WHEN gross_return <= 0 THEN 0.0 END), 0), 6) AS unconditional_hit_rate
    FROM k JOIN (VALUES (43), (67), (96)) mm(m) ON true LEFT JOIN oc ON oc.run_id = k.run_id AND oc.horizon = k.horizon AND oc.direction = k.direction AND oc.entry_index >= m
    GROUP BY 1, 2, 3, 4""",
)
add(
    "NUL2_forbidden_entries",
    lambda s, d: N.forbidden_entries(events(s, d).filter(F.col("direction").isNotNull()), HORIZONS, 5).select(
        "run_id", F.col("horizon").cast("long").alias("horizon"), "entry_index"),
    f"""WITH {EV_SQL}, b AS (SELECT DISTINCT run_id, entry_index FROM ev WHERE direction IS NOT NULL)
    SELECT DISTINCT run_id, horizon, unnest(range(greatest(0, entry_index - horizon + 1 - 5), entry_index + horizon + 5)) AS entry_index
    FROM b, (VALUES (1), (3), (5), (10), (20)) h(horizon)""",
)

SIZE = 5 * PROC.controls_per_event
POOL_SQL = f"""{plan_sql(PROC.horizons)}, {out_sql(PROC.horizons)},
vol0 AS (SELECT *, ln(close) - ln(lag(close) OVER ({W})) AS r FROM bars),
vol AS (SELECT run_id, bar_index, entry_spread, CASE WHEN count(r) OVER f > 1 THEN stddev_pop(r) OVER f ELSE 0 END AS tv FROM vol0
   WINDOW f AS ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
fb AS (SELECT DISTINCT run_id, horizon, unnest(range(greatest(0, entry_index - horizon + 1 - 5), entry_index + horizon + 5)) AS i
   FROM (SELECT DISTINCT run_id, entry_index FROM ev WHERE direction IS NOT NULL) b, (VALUES {", ".join(f"({h})" for h in PROC.horizons)}) h(horizon)),
pl AS (SELECT vol.run_id, horizon, bar_index AS idx, ln(tv + 1e-12) AS u, ln(entry_spread + 1e-12) AS v FROM vol JOIN nb USING (run_id),
   (VALUES {", ".join(f"({h})" for h in PROC.horizons)}) h(horizon) WHERE bar_index >= 43 AND bar_index <= n_bars - horizon
   AND NOT EXISTS (SELECT 1 FROM fb WHERE fb.run_id = vol.run_id AND fb.horizon = h.horizon AND fb.i = vol.bar_index)),
tg AS (SELECT DISTINCT tr.run_id, horizon, entry_index AS target, ln(tv + 1e-12) AS u0, ln(entry_spread + 1e-12) AS v0
   FROM tr JOIN vol ON vol.run_id = tr.run_id AND vol.bar_index = tr.entry_index WHERE status = 'accepted'),
ds AS (SELECT tg.run_id, tg.horizon, target, idx, abs(u - u0) + 0.25 * abs(v - v0) AS dist FROM tg JOIN pl ON pl.run_id = tg.run_id AND pl.horizon = tg.horizon),
nn AS (SELECT *, row_number() OVER (PARTITION BY run_id, horizon, target ORDER BY dist, idx) AS rk FROM ds),
np AS (SELECT * FROM nn WHERE rk <= {SIZE})"""


def targets(s, d) -> DataFrame:
    t = proc_trades(s, d).filter("status = 'accepted'").withColumn(
        "min_entry", N.minimum_entry(F.col("observation_window_length")))
    at = states(s, d).select("run_id", F.col("bar_index").alias("target"), "trailing_vol", "entry_spread")
    return sorted_join(t.select(*N.POOL, F.col("entry_index").alias("target")).distinct(), at, ["run_id", "target"])


def pool(s, d) -> DataFrame:
    return N.control_pool(states(s, d), None, events(s, d).filter(F.col("direction").isNotNull()),
                          PROC.horizons, [MIN_ENTRY], PROC.embargo)


def nearest(s, d) -> DataFrame:
    return stored(s, ("nearest", d), lambda: N.nearest_pool(pool(s, d), targets(s, d), SIZE))


add(
    "NUL3_state_distance",
    lambda s, d: sorted_join(pool(s, d), targets(s, d).select("run_id", "horizon", "target", F.struct("trailing_vol", "entry_spread").alias("t")), ["run_id", "horizon"])
    .select("run_id", F.col("horizon").cast("long").alias("horizon"), "target", "entry_index",
            r6("distance", N.state_distance(F.col("trailing_vol"), F.col("entry_spread"), F.col("t.trailing_vol"), F.col("t.entry_spread")))),
    f"""WITH RECURSIVE {POOL_SQL} SELECT run_id, horizon, target, idx AS entry_index, round(dist, 6) AS distance FROM ds""",
)
add(
    "NUL4_nearest_pool",
    lambda s, d: nearest(s, d).select("run_id", F.col("horizon").cast("long").alias("horizon"), "target", "entry_index",
                                      r6("distance"), F.col("pool_rank").cast("long").alias("pool_rank")),
    f"WITH RECURSIVE {POOL_SQL} SELECT run_id, horizon, target, idx AS entry_index, round(dist, 6) AS distance, rk AS pool_rank FROM np",
)


def prefixes(s, d) -> DataFrame:
    return N.price_prefixes(V.lineitem_bars(s, d))


def _digits(c: str) -> str:
    return f"CAST({c} AS VARCHAR)"


PREFIX_SQL = f"""pf AS (SELECT run_id, bar_index, sha256(bar_index || ':' || CAST(sum(CAST(('0x' || substr(md5(bar_index || '|' || {_digits('open')} || '|' || {_digits('high')} || '|' ||
  {_digits('low')} || '|' || {_digits('close')} || '|' || volume), 1, 15))::UBIGINT AS HUGEINT)) OVER ({W}) AS VARCHAR)) AS prefix FROM bars)"""
add("NUL6_causal_draw_seed",
    lambda s, d: prefixes(s, d),
    f"WITH {S.LI}, {PREFIX_SQL} SELECT run_id, bar_index, prefix FROM pf")

DRAW_SQL = f"""{POOL_SQL}, {PREFIX_SQL},
dr0 AS (SELECT DISTINCT run_id, horizon, entry_index AS target, pattern_name, available_at_index FROM tr WHERE status = 'accepted'),
dr1 AS (SELECT dr0.*, prefix FROM dr0 JOIN pf ON pf.run_id = dr0.run_id AND pf.bar_index = available_at_index),
dr AS (SELECT dr1.run_id, dr1.horizon, dr1.target, pattern_name, idx, row_number() OVER (PARTITION BY dr1.run_id, dr1.horizon, dr1.target, pattern_name
   ORDER BY md5(prefix || '|' || pattern_name || '|' || dr1.target || '|' || dr1.horizon || '|' || idx), idx) AS k
   FROM dr1 JOIN np ON np.run_id = dr1.run_id AND np.horizon = dr1.horizon AND np.target = dr1.target),
dn AS (SELECT * FROM dr WHERE k <= {PROC.controls_per_event}),
nu AS (SELECT tr.run_id, tr.hypothesis, tr.horizon, tr.event_id, count(*) AS n, avg(net_return) AS m, avg(CASE WHEN gross_return > 0 THEN 1.0 ELSE 0.0 END) AS a
   FROM tr JOIN dn ON dn.run_id = tr.run_id AND dn.horizon = tr.horizon AND dn.target = tr.entry_index AND dn.pattern_name = tr.pattern_name
   JOIN oc ON oc.run_id = tr.run_id AND oc.horizon = tr.horizon AND oc.direction = tr.direction AND oc.entry_index = dn.idx
   WHERE status = 'accepted' GROUP BY 1, 2, 3, 4)"""


def drawn(s, d) -> DataFrame:
    t = proc_trades(s, d).filter("status = 'accepted'").withColumn(
        "min_entry", N.minimum_entry(F.col("observation_window_length")))
    draws = N.seeded_draws(t, V.lineitem_bars(s, d))
    return N.draw_controls(nearest(s, d).drop("distance", "pool_rank"), draws, PROC.controls_per_event)


add(
    "NUL5_control_draw",
    lambda s, d: drawn(s, d).select("run_id", F.col("horizon").cast("long").alias("horizon"), "target", "pattern_name", "entry_index"),
    f"WITH RECURSIVE {DRAW_SQL} SELECT run_id, horizon, target, pattern_name, idx AS entry_index FROM dn",
)


def obs(s, d) -> DataFrame:
    def build():
        t = proc_trades(s, d)
        return N.observations(V.lineitem_bars(s, d), events(s, d), t, PROC, X.horizon_exits(V.lineitem_bars(s, d), PROC.horizons), states(s, d), [MIN_ENTRY])
    return stored(s, ("observations", d), build)


OBS_SQL = f"""{DRAW_SQL},
un AS (SELECT run_id, horizon, direction, avg(net_return) AS um FROM oc WHERE entry_index >= 43 GROUP BY 1, 2, 3),
ob AS (SELECT tr.run_id, tr.hypothesis, tr.horizon, tr.event_id, tr.pattern_name, tr.direction, tr.entry_index, tr.exit_index, gross_return, spread_slippage_cost,
   brokerage_cost, total_transaction_cost, net_return, gross_return > 0 AS ok1, um, CASE WHEN n >= {PROC.min_controls} THEN m END AS nm,
   CASE WHEN n >= {PROC.min_controls} THEN a END AS na, coalesce(n, 0) AS nn_count
   FROM tr JOIN oc ON oc.run_id = tr.run_id AND oc.horizon = tr.horizon AND oc.direction = tr.direction AND oc.entry_index = tr.entry_index
   LEFT JOIN un ON un.run_id = tr.run_id AND un.horizon = tr.horizon AND un.direction = tr.direction
   LEFT JOIN nu ON nu.run_id = tr.run_id AND nu.hypothesis = tr.hypothesis AND nu.horizon = tr.horizon AND nu.event_id = tr.event_id WHERE status = 'accepted')"""

add(
    "NUL7_matched_null_means",
    lambda s, d: obs(s, d).select("run_id", "hypothesis", F.col("horizon").cast("long").alias("horizon"), "event_id", "matched_null_count",
                                  r6("matched_null_mean_net_return"), r6("matched_null_direction_accuracy")),
    f"""WITH RECURSIVE {OBS_SQL} SELECT run_id, hypothesis, horizon, event_id, nn_count AS matched_null_count,
    round(nm, 6) AS matched_null_mean_net_return, round(na, 6) AS matched_null_direction_accuracy FROM ob""",
)
add(
    "TRD12_observations",
    lambda s, d: obs(s, d).select(
        "run_id", "hypothesis", "pattern_name", "event_id", F.col("horizon").cast("long").alias("horizon"),
        F.col("direction").cast("long").alias("direction"), "entry_index", "exit_index", *[r6(c) for c in RET],
        "directional_correct", r6("unconditional_mean_net_return"), r6("matched_null_mean_net_return"), "matched_null_count"),
    f"""WITH RECURSIVE {OBS_SQL} SELECT run_id, hypothesis, pattern_name, event_id, horizon, direction, entry_index, exit_index, {S.pick(RET)},
    ok1 AS directional_correct, round(um, 6) AS unconditional_mean_net_return, round(nm, 6) AS matched_null_mean_net_return, nn_count AS matched_null_count FROM ob""",
)

# --- AGG1-AGG12 ------------------------------------------------------------------------------

METRIC = ["total_gross_return", "total_transaction_cost", "total_net_return", "mean_net_return", "median_net_return", "mean_effect_vs_matched",
          "mean_effect_vs_unconditional", "mean_matched_null_net_return", "mean_unconditional_net_return", "direction_accuracy",
          "matched_null_direction_accuracy", "matched_event_direction_accuracy"]
COUNTS = ["event_count", "matched_null_event_count", "skipped_overlap_count", "untradeable_event_count", "direction_correct_count"]


def metrics(s, d) -> DataFrame:
    def build():
        grid = I.run_grid(V.supplier_runs(s, d), PROC.horizons)
        return I.run_metrics(grid, proc_trades(s, d), obs(s, d))
    return stored(s, ("run_metrics", d), build)


HYP_VALUES = ", ".join(f"('{n}')" for n in I.HYPOTHESES)
RM_SQL = f"""{OBS_SQL}, {S.SUPPLIER_RUNS},
gr AS (SELECT runs.*, hypothesis, horizon FROM runs, (VALUES {HYP_VALUES}) hv(hypothesis), (VALUES {", ".join(f"({h})" for h in PROC.horizons)}) hz(horizon)),
ls AS (SELECT run_id, hypothesis, horizon, count(*) FILTER (status = 'skipped') AS sk, count(*) FILTER (status = 'untradeable') AS ut FROM tr GROUP BY 1, 2, 3),
oa AS (SELECT run_id, hypothesis, horizon, count(*) AS n, count(nm) AS nmc, sum(gross_return) AS g, sum(total_transaction_cost) AS c, sum(net_return) AS net,
   avg(net_return) AS mn, median(net_return) AS md, avg(net_return - nm) AS em, avg(net_return - um) AS eu, avg(nm) AS mnn, avg(um) AS mu,
   sum(CASE WHEN ok1 THEN 1 ELSE 0 END) AS hits, avg(CASE WHEN ok1 THEN 1.0 ELSE 0.0 END) AS acc, avg(na) AS nacc,
   avg(CASE WHEN nm IS NOT NULL THEN CASE WHEN ok1 THEN 1.0 ELSE 0.0 END END) AS macc FROM ob GROUP BY 1, 2, 3),
rm AS (SELECT gr.run_id, gr.seed, gr.structure_id, gr.world_family, gr.hypothesis, gr.horizon, CAST(coalesce(n, 0) AS BIGINT) AS event_count, CAST(coalesce(nmc, 0) AS BIGINT) AS matched_null_event_count,
   CAST(coalesce(sk, 0) AS BIGINT) AS skipped_overlap_count, CAST(coalesce(ut, 0) AS BIGINT) AS untradeable_event_count, coalesce(g, 0) AS total_gross_return, coalesce(c, 0) AS total_transaction_cost,
   coalesce(net, 0) AS total_net_return, coalesce(mn, 0) AS mean_net_return, coalesce(md, 0) AS median_net_return, em AS mean_effect_vs_matched,
   eu AS mean_effect_vs_unconditional, mnn AS mean_matched_null_net_return, mu AS mean_unconditional_net_return, CAST(coalesce(hits, 0) AS BIGINT) AS direction_correct_count,
   acc AS direction_accuracy, nacc AS matched_null_direction_accuracy, macc AS matched_event_direction_accuracy
   FROM gr LEFT JOIN ls USING (run_id, hypothesis, horizon) LEFT JOIN oa USING (run_id, hypothesis, horizon))"""
add(
    "AGG1_run_metrics",
    lambda s, d: metrics(s, d).select("structure_id", "run_id", "seed", "hypothesis", F.col("horizon").cast("long").alias("horizon"),
                                      *COUNTS, *[r6(c) for c in METRIC]),
    f"WITH RECURSIVE {RM_SQL} SELECT structure_id, run_id, seed, hypothesis, horizon, {', '.join(COUNTS)}, {S.pick(METRIC)} FROM rm",
)


def _ci_block(s, d):
    from candlemill.functions.student_t import mean_ci
    g = metrics(s, d).groupBy("structure_id", "hypothesis", "horizon").agg(
        F.count("total_net_return").alias("n"), F.avg("total_net_return").alias("m"), F.stddev_samp("total_net_return").alias("sd"))
    m, lo, hi = mean_ci(F.col("n"), F.col("m"), F.col("sd"))
    return g.select("structure_id", "hypothesis", F.col("horizon").cast("long").alias("horizon"), r6("mean", m), r6("ci_low", lo), r6("ci_high", hi))


def _p_block(s, d):
    from candlemill.functions.student_t import positive_mean_p
    g = metrics(s, d).groupBy("structure_id", "hypothesis", "horizon").agg(
        F.count("total_net_return").alias("n"), F.avg("total_net_return").alias("m"), F.stddev_samp("total_net_return").alias("sd"))
    return g.select("structure_id", "hypothesis", F.col("horizon").cast("long").alias("horizon"),
                    r6("p_value", positive_mean_p(F.col("n"), F.col("m"), F.col("sd"))))


G_SQL = f"""{RM_SQL}, gg AS (SELECT structure_id, hypothesis, horizon, count(*) AS n, avg(total_net_return) AS m, stddev_samp(total_net_return) AS sd FROM rm GROUP BY 1, 2, 3)"""
_lo, _hi = ci_columns("n", "m", "sd", "x")
add("AGG2_mean_t_interval", _ci_block,
    f"""WITH RECURSIVE {G_SQL}, {critical_cte()} SELECT structure_id, hypothesis, horizon, round(m, 6) AS mean, round({_lo}, 6) AS ci_low, round({_hi}, 6) AS ci_high
    FROM gg LEFT JOIN tcrit tc_x ON tc_x.df = n - 1""")
add("AGG3_positive_mean_p_value", _p_block,
    f"WITH RECURSIVE {G_SQL} SELECT structure_id, hypothesis, horizon, round({p_expr('n', 'm', 'sd')}, 6) AS p_value FROM gg")


def _wilson(s, d):
    o = obs(s, d).groupBy("hypothesis", "horizon").agg(F.sum(F.col("directional_correct").cast("long")).alias("hits"), F.count(F.lit(1)).alias("trials"))
    lo, hi = I.wilson_interval(F.col("hits"), F.col("trials"))
    return o.select("hypothesis", F.col("horizon").cast("long").alias("horizon"), "hits", "trials", r6("low", lo), r6("high", hi))


add("AGG4_wilson_interval", _wilson,
    f"""WITH RECURSIVE {OBS_SQL}, w AS (SELECT hypothesis, horizon, CAST(sum(CASE WHEN ok1 THEN 1 ELSE 0 END) AS BIGINT) AS hits, count(*) AS trials FROM ob GROUP BY 1, 2),
    v AS (SELECT *, 1.959963984540054::DOUBLE AS z, hits / trials::DOUBLE AS p FROM w)
    SELECT hypothesis, horizon, hits, trials, round(greatest(0, (p + z*z/(2*trials) - z*sqrt(p*(1-p)/trials + z*z/(4*trials*trials))) / (1 + z*z/trials)), 6) AS low,
      round(least(1, (p + z*z/(2*trials) + z*sqrt(p*(1-p)/trials + z*z/(4*trials*trials))) / (1 + z*z/trials)), 6) AS high FROM v""")

_series = {"total": "total_net_return", "net": "CASE WHEN event_count > 0 THEN mean_net_return END",
           "eff": "CASE WHEN matched_null_event_count > 0 THEN mean_effect_vs_matched END",
           "acc": "CASE WHEN event_count > 0 THEN direction_accuracy END",
           "lift": "CASE WHEN matched_null_event_count > 0 THEN matched_event_direction_accuracy - matched_null_direction_accuracy END"}


def agg_sql(source: str, prefix: str = "", name: str = "hy") -> str:
    stats = ", ".join(f"count({e}) AS n_{k}, avg({e}) AS m_{k}, stddev_samp({e}) AS s_{k}" for k, e in _series.items())
    ci = {k: ci_columns(f"n_{k}", f"m_{k}", f"s_{k}", k) for k in _series}
    joins = " ".join(f"LEFT JOIN tcrit tc_{k} ON tc_{k}.df = n_{k} - 1" for k in _series)
    return f"""{name}0 AS (SELECT structure_id, hypothesis, horizon, count(*) AS seed_count_total, count(*) FILTER (event_count > 0) AS seed_count_with_events,
   count(*) FILTER (matched_null_event_count > 0 AND mean_effect_vs_matched IS NOT NULL) AS seed_count_with_matched_nulls, CAST(sum(event_count) AS BIGINT) AS event_count,
   CAST(sum(matched_null_event_count) AS BIGINT) AS matched_null_event_count, CAST(sum(skipped_overlap_count) AS BIGINT) AS skipped_overlap_count,
   CAST(sum(untradeable_event_count) AS BIGINT) AS untradeable_event_count, sum(total_net_return) AS net_return_points_sum_across_seeds, sum(total_gross_return) AS gr, sum(total_transaction_cost) AS co,
   sum(mean_net_return * event_count) AS nw, sum(direction_correct_count) AS hits, avg(CASE WHEN event_count > 0 THEN mean_effect_vs_unconditional END) AS mean_effect_vs_unconditional,
   sum(CASE WHEN matched_null_event_count > 0 THEN matched_null_direction_accuracy * matched_null_event_count END) AS naw,
   avg(CASE WHEN matched_null_event_count > 0 THEN matched_null_direction_accuracy END) AS mean_seed_matched_null_direction_accuracy, {stats} FROM {source} GROUP BY 1, 2, 3),
{name} AS (SELECT structure_id, hypothesis, horizon, seed_count_total, seed_count_with_events, seed_count_with_matched_nulls, event_count, matched_null_event_count,
   skipped_overlap_count, untradeable_event_count, net_return_points_sum_across_seeds, m_total AS mean_net_return_points_per_seed,
   {ci['total'][0]} AS mean_net_return_points_per_seed_ci_low, {ci['total'][1]} AS mean_net_return_points_per_seed_ci_high,
   coalesce(gr / nullif(event_count, 0), 0) AS mean_gross_return_per_trade, coalesce(co / nullif(event_count, 0), 0) AS mean_transaction_cost_per_trade,
   coalesce(nw / nullif(event_count, 0), 0) AS mean_net_return_per_trade, m_net AS mean_seed_net_return, {ci['net'][0]} AS mean_seed_net_return_ci_low, {ci['net'][1]} AS mean_seed_net_return_ci_high,
   m_eff AS mean_effect_vs_matched, {ci['eff'][0]} AS mean_effect_vs_matched_ci_low, {ci['eff'][1]} AS mean_effect_vs_matched_ci_high, mean_effect_vs_unconditional,
   CASE WHEN s_eff > 0 THEN m_eff / s_eff END AS standardized_seed_effect, m_acc AS direction_accuracy, hits / nullif(event_count, 0) AS direction_accuracy_event_weighted_descriptive,
   CASE WHEN n_acc >= 2 THEN greatest(0, {ci['acc'][0]}) END AS direction_accuracy_ci_low, CASE WHEN n_acc >= 2 THEN least(1, {ci['acc'][1]}) END AS direction_accuracy_ci_high,
   naw / nullif(matched_null_event_count, 0) AS matched_null_direction_accuracy, mean_seed_matched_null_direction_accuracy, m_lift AS direction_accuracy_lift_vs_matched,
   {ci['lift'][0]} AS direction_accuracy_lift_ci_low, {ci['lift'][1]} AS direction_accuracy_lift_ci_high,
   {p_expr('n_eff', 'm_eff', 's_eff')} AS raw_p_value_effect_vs_matched, {p_expr('n_total', 'm_total', 's_total')} AS raw_p_value_positive_total_net_return,
   greatest({p_expr('n_eff', 'm_eff', 's_eff')}, {p_expr('n_total', 'm_total', 's_total')}) AS raw_p_value_primary_edge FROM {name}0 {joins})"""


H_COUNT = ["seed_count_total", "seed_count_with_events", "seed_count_with_matched_nulls", "event_count", "matched_null_event_count",
           "skipped_overlap_count", "untradeable_event_count"]
H_REAL = ["net_return_points_sum_across_seeds", "mean_net_return_points_per_seed", "mean_net_return_points_per_seed_ci_low",
          "mean_net_return_points_per_seed_ci_high", "mean_gross_return_per_trade", "mean_transaction_cost_per_trade", "mean_net_return_per_trade",
          "mean_seed_net_return", "mean_seed_net_return_ci_low", "mean_seed_net_return_ci_high", "mean_effect_vs_matched",
          "mean_effect_vs_matched_ci_low", "mean_effect_vs_matched_ci_high", "mean_effect_vs_unconditional", "standardized_seed_effect",
          "direction_accuracy", "direction_accuracy_event_weighted_descriptive", "direction_accuracy_ci_low", "direction_accuracy_ci_high",
          "matched_null_direction_accuracy", "mean_seed_matched_null_direction_accuracy", "direction_accuracy_lift_vs_matched",
          "direction_accuracy_lift_ci_low", "direction_accuracy_lift_ci_high", "raw_p_value_effect_vs_matched",
          "raw_p_value_positive_total_net_return", "raw_p_value_primary_edge"]
HKEY = ["structure_id", "hypothesis", "horizon"]


def hkey():
    return ["structure_id", "hypothesis", F.col("horizon").cast("long").alias("horizon")]


def hypotheses(s, d) -> DataFrame:
    return stored(s, ("hypotheses", d), lambda: I.aggregate_metrics(metrics(s, d), PROC))


HY_SQL = f"{RM_SQL}, {critical_cte()}, {agg_sql('rm')}"
add(
    "AGG5_hypothesis_aggregate",
    lambda s, d: hypotheses(s, d).select(*hkey(), *H_COUNT, *[r6(c) for c in H_REAL]),
    f"WITH RECURSIVE {HY_SQL} SELECT {', '.join(HKEY)}, {', '.join(H_COUNT)}, {S.pick(H_REAL)} FROM hy",
)
BH_SQL = f"""{HY_SQL}, bh0 AS (SELECT *, row_number() OVER (ORDER BY raw_p_value_primary_edge, structure_id, hypothesis, horizon) AS rk, count(*) OVER () AS mm FROM hy),
bh AS (SELECT *, least(1, min(raw_p_value_primary_edge * mm / rk) OVER (ORDER BY rk DESC)) AS q,
  max(least(1, (mm - rk + 1) * raw_p_value_primary_edge)) OVER (ORDER BY rk) AS h FROM bh0)"""
add(
    "AGG6_benjamini_hochberg",
    lambda s, d: I.benjamini_hochberg(hypotheses(s, d), "raw_p_value_primary_edge", "q", HKEY).select(*hkey(), r6("q")),
    f"WITH RECURSIVE {BH_SQL} SELECT {', '.join(HKEY)}, round(q, 6) AS q FROM bh",
)
add(
    "AGG7_holm",
    lambda s, d: I.holm(hypotheses(s, d), "raw_p_value_primary_edge", "h", HKEY).select(*hkey(), r6("h")),
    f"WITH RECURSIVE {BH_SQL} SELECT {', '.join(HKEY)}, round(h, 6) AS h FROM bh",
)
LOOSE = ProcedureConfig(horizons=(5, 10), controls_per_event=8, min_controls=5, min_events=3, min_seeds=2, alpha=0.05, top_k=100)


def sup(p: str, a: float) -> str:
    return (f"event_count >= 3 AND matched_null_event_count >= 3 AND seed_count_with_events >= 2 AND seed_count_with_matched_nulls >= 2 "
            f"AND mean_net_return_per_trade > 0 AND coalesce(mean_effect_vs_matched > 0, false) AND {p} <= {a}")


# The correction covers every hypothesis that was tried; the tables hold no real effect, so an empty selection is right.
SEL_SQL = f"""{RM_SQL}, {critical_cte()}, {agg_sql('rm', name='hy_all')}, hy AS (SELECT * FROM hy_all),
bh0 AS (SELECT *, row_number() OVER (ORDER BY raw_p_value_primary_edge, structure_id, hypothesis, horizon) AS rk, count(*) OVER () AS mm FROM hy),
bh AS (SELECT *, least(1, min(raw_p_value_primary_edge * mm / rk) OVER (ORDER BY rk DESC)) AS q FROM bh0), sel AS (SELECT * FROM bh WHERE {sup('q', 0.05)} ORDER BY q, mean_effect_vs_matched DESC, mean_net_return_per_trade DESC, event_count DESC, structure_id, hypothesis, horizon LIMIT 100)"""
add(
    "AGG8_discovery_selection",
    lambda s, d: I.select_discovery(hypotheses(s, d), LOOSE).select(*hkey(), "event_count", r6("discovery_fdr_q_value")),
    f"WITH RECURSIVE {SEL_SQL} SELECT {', '.join(HKEY)}, event_count, round(q, 6) AS discovery_fdr_q_value FROM sel",
)


def halves(s, d, odd: int) -> DataFrame:
    """Discovery (0) and held-out (1) seeds; the two never meet."""
    return metrics(s, d).filter((F.col("seed") % 4 == 0) == bool(odd))


def validated(s, d) -> DataFrame:
    picked = I.select_discovery(I.aggregate_metrics(halves(s, d, 0), LOOSE), LOOSE)
    return I.validate_selected(I.aggregate_metrics(halves(s, d, 1), LOOSE), picked, LOOSE)


VAL_SQL = f"""{RM_SQL}, {critical_cte()}, rm0 AS (SELECT * FROM rm WHERE seed % 4 <> 0), rm1 AS (SELECT * FROM rm WHERE seed % 4 = 0),
{agg_sql('rm0', name='hd')}, {agg_sql('rm1', name='hv2')},
d0 AS (SELECT *, row_number() OVER (ORDER BY raw_p_value_primary_edge, structure_id, hypothesis, horizon) AS rk, count(*) OVER () AS mm FROM hd),
d1 AS (SELECT *, least(1, min(raw_p_value_primary_edge * mm / rk) OVER (ORDER BY rk DESC)) AS q FROM d0),
sel AS (SELECT * FROM d1 WHERE {sup('q', 0.05)} ORDER BY q, mean_effect_vs_matched DESC, mean_net_return_per_trade DESC, event_count DESC, structure_id, hypothesis, horizon LIMIT 100),
v0 AS (SELECT hv2.* FROM hv2 JOIN sel USING (structure_id, hypothesis, horizon)),
v1 AS (SELECT *, row_number() OVER (ORDER BY raw_p_value_primary_edge, structure_id, hypothesis, horizon) AS rk, count(*) OVER () AS mm FROM v0),
v2 AS (SELECT *, max(least(1, (mm - rk + 1) * raw_p_value_primary_edge)) OVER (ORDER BY rk) AS h FROM v1),
vv AS (SELECT *, coalesce({sup('h', 0.05)}, false) AS validated FROM v2)"""
add(
    "AGG9_held_out_validation",
    lambda s, d: validated(s, d).select(*hkey(), r6("validation_holm_p_value"), "validated"),
    f"WITH RECURSIVE {VAL_SQL} SELECT {', '.join(HKEY)}, round(h, 6) AS validation_holm_p_value, validated FROM vv",
)


def ranked(s, d) -> DataFrame:
    full = I.holm(hypotheses(s, d), "raw_p_value_primary_edge", "validation_holm_p_value", HKEY)
    return I.structure_rankings(full.withColumn("validated", F.col("mean_net_return_per_trade") > 0))


add(
    "AGG10_structure_ranking",
    lambda s, d: ranked(s, d).select(
        "structure_id", "validated_hypothesis_count", "best_pattern", F.col("best_horizon").cast("long").alias("best_horizon"),
        r6("best_mean_net_return_per_trade"), "best_event_count", F.col("best_portfolio_horizon").cast("long").alias("best_portfolio_horizon"),
        r6("best_portfolio_mean_net_return_points_per_seed"), F.col("rank").cast("long").alias("rank")),
    f"""WITH RECURSIVE {BH_SQL}, vr AS (SELECT * FROM bh WHERE mean_net_return_per_trade > 0),
    b1 AS (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY mean_net_return_per_trade DESC, mean_effect_vs_matched DESC NULLS LAST, h, hypothesis DESC, horizon DESC) AS k, count(*) OVER (PARTITION BY structure_id) AS vc FROM vr),
    p1 AS (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY mean_net_return_points_per_seed DESC, horizon) AS k FROM vr WHERE hypothesis = '__all_patterns__')
    SELECT b1.structure_id, vc AS validated_hypothesis_count, b1.hypothesis AS best_pattern, b1.horizon AS best_horizon, round(b1.mean_net_return_per_trade, 6) AS best_mean_net_return_per_trade,
      b1.event_count AS best_event_count, p1.horizon AS best_portfolio_horizon, round(p1.mean_net_return_points_per_seed, 6) AS best_portfolio_mean_net_return_points_per_seed,
      row_number() OVER (ORDER BY p1.mean_net_return_points_per_seed DESC NULLS LAST, b1.mean_net_return_per_trade DESC, b1.h, b1.structure_id) AS rank
    FROM b1 LEFT JOIN p1 ON p1.structure_id = b1.structure_id AND p1.k = 1 WHERE b1.k = 1""",
)


def clustered(s, d) -> DataFrame:
    return metrics(s, d).withColumn("cluster", F.col("seed") % 10)


P_REAL = ["total_gross_return", "total_transaction_cost", "total_net_return", "mean_net_return", "mean_effect_vs_matched", "mean_effect_vs_unconditional",
          "mean_matched_null_net_return", "mean_unconditional_net_return", "direction_accuracy", "matched_null_direction_accuracy", "matched_event_direction_accuracy"]


def _wm(f, k):
    return f"sum(CASE WHEN {k} > 0 THEN {f} * {k} END) / nullif(sum(CASE WHEN {k} > 0 THEN {k} END), 0) AS {f}"


POOLED_SQL = f"""{RM_SQL}, pc AS (SELECT seed % 10 AS cluster, 'REAL-POOLED' AS structure_id, 'REAL-CLUSTER-' || (seed % 10) AS run_id, hypothesis, horizon,
   {", ".join(f"CAST(sum(rm.{c}) AS BIGINT) AS {c}" for c in COUNTS)}, sum(total_gross_return) AS total_gross_return, sum(total_transaction_cost) AS total_transaction_cost, sum(total_net_return) AS total_net_return,
   coalesce(sum(rm.mean_net_return * rm.event_count) / nullif(sum(rm.event_count), 0), 0) AS mean_net_return,
   {_wm('rm.mean_effect_vs_matched', 'rm.matched_null_event_count').replace('AS rm.', 'AS ')}, {_wm('rm.mean_effect_vs_unconditional', 'rm.event_count').replace('AS rm.', 'AS ')},
   {_wm('rm.mean_matched_null_net_return', 'rm.matched_null_event_count').replace('AS rm.', 'AS ')}, {_wm('rm.mean_unconditional_net_return', 'rm.event_count').replace('AS rm.', 'AS ')},
   {_wm('rm.matched_null_direction_accuracy', 'rm.matched_null_event_count').replace('AS rm.', 'AS ')}, {_wm('rm.matched_event_direction_accuracy', 'rm.matched_null_event_count').replace('AS rm.', 'AS ')},
   sum(rm.direction_correct_count) / nullif(sum(rm.event_count), 0)::DOUBLE AS direction_accuracy FROM rm GROUP BY 1, 2, 3, 4, 5)"""
add(
    "AGG11_cluster_pooling",
    lambda s, d: I.pool_clusters(clustered(s, d)).select("run_id", "structure_id", "hypothesis", F.col("horizon").cast("long").alias("horizon"),
                                                         *COUNTS, *[r6(c) for c in P_REAL]),
    f"WITH RECURSIVE {POOLED_SQL} SELECT run_id, structure_id, hypothesis, horizon, {', '.join(COUNTS)}, {S.pick(P_REAL)} FROM pc",
)
add(
    "AGG12_pooled_real_validation",
    lambda s, d: I.pooled_validation(clustered(s, d), LOOSE).select(*hkey(), "event_count", r6("mean_net_return_per_trade"),
                                                                    r6("raw_p_value_primary_edge"), r6("real_holm_p_value"), "real_validated"),
    f"""WITH RECURSIVE {POOLED_SQL}, {critical_cte()}, {agg_sql('pc')}, v1 AS (SELECT *, row_number() OVER (ORDER BY raw_p_value_primary_edge, structure_id, hypothesis, horizon) AS rk, count(*) OVER () AS mm FROM hy),
    v2 AS (SELECT *, max(least(1, (mm - rk + 1) * raw_p_value_primary_edge)) OVER (ORDER BY rk) AS h FROM v1)
    SELECT {', '.join(HKEY)}, event_count, round(mean_net_return_per_trade, 6) AS mean_net_return_per_trade, round(raw_p_value_primary_edge, 6) AS raw_p_value_primary_edge,
    round(h, 6) AS real_holm_p_value, coalesce({sup('h', 0.05)}, false) AS real_validated FROM v2""",
)
