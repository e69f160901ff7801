"""DS, SET and JON rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from candlemill.catalog import sql as S
from candlemill.catalog.bars_and_features import r6
from candlemill.catalog.pattern_rows import found
from candlemill.catalog.registry import add
from candlemill.catalog.trading import EV_SQL, W, bar_counts, events, out_sql, states
from candlemill.config import ExperimentConfig
from candlemill.operators import dataset as D, dependence as J, features as T, grids as G, trades as X
from candlemill.patterns.detect import confirmed_events
from candlemill.sources import views as V
from candlemill.sources.series import stored

CFG = ExperimentConfig()


def geometry_rows(s, d) -> DataFrame:
    return D.pattern_features(confirmed_events(found(s, d).candidates))


def labelled_rows(s, d) -> DataFrame:
    """Full feature rows of the walk series with outcomes over 20 bars."""

    def build():
        bars = V.walk_bars(s, d)
        ticks = V.event_ticks(s, d).withColumns({"post_bid": F.col("bid"), "post_ask": F.col("ask")})
        return D.label_rows(geometry_rows(s, d), bars, [T.bar_features(bars).select("run_id", "bar_index", *D.BAR_FEATURES),
                                                      T.flow_features(ticks, 1, 20)], CFG.horizon)

    return stored(s, ("labelled", d), build)


add("DS1_pattern_geometry_features", lambda s, d: geometry_rows(s, d).select(
    "run_id", "event_id", *[r6(c) for c in (*D.EVENT_FEATURES, *D.GEOMETRY_FEATURES)]))
add(
    "DS2_latent_state_features",
    lambda s, d: D.latent_features(events(s, d), states(s, d), ["trailing_vol", "entry_spread"]).select(
        "event_id", r6("oracle_trailing_vol"), r6("oracle_entry_spread")),
    f"""WITH {EV_SQL}, v0 AS (SELECT *, ln(close) - ln(lag(close) OVER ({W})) AS r FROM bars),
    v AS (SELECT run_id, bar_index, entry_spread, CASE WHEN count(r) OVER f > 1 THEN stddev_pop(r) OVER f ELSE 0 END AS tv FROM v0 WINDOW f AS ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
    SELECT event_id, round(tv, 6) AS oracle_trailing_vol, round(entry_spread, 6) AS oracle_entry_spread FROM ev LEFT JOIN v ON v.run_id = ev.run_id AND v.bar_index = ev.available_at_index""",
)
LABEL_OUT = ["gross_directional_return", "net_directional_return", "total_transaction_cost", "maximum_favorable_transaction_excursion", "maximum_adverse_transaction_excursion"]
add("DS3_pattern_label_rows", lambda s, d: labelled_rows(s, d).select(
    "run_id", "event_id", "pattern_type", "trade_direction", "available_at_index", "entry_index", "exit_index", *[r6(c) for c in LABEL_OUT],
    *[r6(c) for c in (*D.BAR_FEATURES, *D.FLOW_FEATURES)], "profitable", "label_horizon_bars"))


def signal_labels(s, d) -> DataFrame:
    bars = V.lineitem_bars(s, d)
    return D.label_rows(events(s, d).drop("direction"), bars, [T.bar_features(bars).select("run_id", "bar_index", *D.BAR_FEATURES)], CFG.horizon)


add(
    "DS3_signal_label_rows",
    lambda s, d: signal_labels(s, d).select("run_id", "event_id", "pattern_type", "trade_direction", "entry_index", "exit_index",
        *[r6(c) for c in LABEL_OUT], r6("recent_return_20"), r6("recent_volatility_50"), r6("recent_trend_strength_20"), F.col("profitable").cast("long").alias("profitable")),
    f"""WITH {EV_SQL}, {out_sql((20,))}, fx AS (SELECT run_id, bar_index, entry_mid, max(high) OVER f AS hi, min(low) OVER f AS lo FROM bars WINDOW f AS ({W} ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
    r AS (SELECT *, ln(close) - ln(lag(close) OVER ({W})) AS r FROM bars),
    ft AS (SELECT run_id, bar_index, close / first_value(close) OVER ({W} ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) - 1 AS r20, coalesce(stddev_samp(r) OVER ({W} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS v50,
      CASE WHEN sum(abs(r)) OVER q > 0 THEN sum(r) OVER q / sum(abs(r)) OVER q ELSE 0 END AS ts FROM r WINDOW q AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
    SELECT ev.run_id, event_id, pattern_name AS pattern_type, side AS trade_direction, ev.entry_index, ev.entry_index + 19 AS exit_index, round(gross_return, 6) AS gross_directional_return,
      round(net_return, 6) AS net_directional_return, round(total_transaction_cost, 6) AS total_transaction_cost,
      round(greatest(0, CASE WHEN ev.direction = 1 THEN hi / entry_mid - 1 ELSE 1 - lo / entry_mid END), 6) AS maximum_favorable_transaction_excursion,
      round(least(0, CASE WHEN ev.direction = 1 THEN lo / entry_mid - 1 ELSE 1 - hi / entry_mid END), 6) AS maximum_adverse_transaction_excursion,
      round(r20, 6) AS recent_return_20, round(v50, 6) AS recent_volatility_50, round(ts, 6) AS recent_trend_strength_20, CASE WHEN net_return > 0 THEN 1 ELSE 0 END AS profitable
    FROM ev JOIN oc ON oc.run_id = ev.run_id AND oc.entry_index = ev.entry_index AND oc.direction = ev.direction JOIN fx ON fx.run_id = ev.run_id AND fx.bar_index = ev.entry_index
    JOIN ft ON ft.run_id = ev.run_id AND ft.bar_index = ev.available_at_index""",
)
RUNSUM = ["n_bars", "events", "confirmed_breakout_events", "training_rows", "skipped_unresolved_direction", "skipped_incomplete_horizon"]
add(
    "DS4_run_summary",
    lambda s, d: D.run_summary(V.supplier_runs(s, d), events(s, d), bar_counts(s, d), 20).select("run_id", "structure_id", "world_family", *RUNSUM),
    f"""WITH {EV_SQL}, {S.SUPPLIER_RUNS}, g AS (SELECT ev.run_id, count(*) AS e, count(*) FILTER (breakout_confirmed) AS c, count(*) FILTER (direction IS NOT NULL AND entry_index + 19 < n_bars) AS t,
      count(*) FILTER (direction IS NULL) AS u, count(*) FILTER (direction IS NOT NULL AND entry_index + 19 >= n_bars) AS l FROM ev JOIN nb ON nb.run_id = ev.run_id GROUP BY 1)
    SELECT runs.run_id, structure_id, world_family, coalesce(n_bars, 0) AS n_bars, coalesce(e, 0) AS events, coalesce(c, 0) AS confirmed_breakout_events, coalesce(t, 0) AS training_rows,
      coalesce(u, 0) AS skipped_unresolved_direction, coalesce(l, 0) AS skipped_incomplete_horizon FROM runs LEFT JOIN nb ON nb.run_id = runs.run_id LEFT JOIN g ON g.run_id = runs.run_id""",
)

SPLIT_SQL = f"""{S.CUSTOMER_RUNS}, st AS (SELECT structure_id, min(world_family) AS world_family, count(DISTINCT run_id) AS run_count FROM runs GROUP BY 1),
s1 AS (SELECT *, CASE WHEN world_family LIKE 'null\\_%' ESCAPE '\\' THEN 'null' ELSE 'structured' END AS split_stratum, sha256('{CFG.base_seed}|' || structure_id) AS h FROM st),
s2 AS (SELECT *, row_number() OVER (PARTITION BY split_stratum ORDER BY h, structure_id) AS k, count(*) OVER (PARTITION BY split_stratum) AS n FROM s1),
sp AS (SELECT *, CASE WHEN k <= round(0.6 * n) THEN 'train' WHEN k <= round(0.6 * n) + round(0.2 * n) THEN 'validation' ELSE 'test' END AS split FROM s2)"""
add("DS5_exact_stratified_split",
    lambda s, d: D.assign_splits(V.customer_runs(s, d), CFG).select("structure_id", "split_stratum", "world_family", "run_count", "split"),
    f"WITH {SPLIT_SQL} SELECT structure_id, split_stratum, world_family, run_count, split FROM sp")


def rows_with_structure(s, d) -> DataFrame:
    return V.order_trades(s, d).join(V.customer_runs(s, d), "run_id")


add("DS6_split_manifest",
    lambda s, d: D.split_manifest(D.assign_splits(V.customer_runs(s, d), CFG), rows_with_structure(s, d)).select(
        "structure_id", "split", "run_count", "runs_with_pattern_rows", "zero_pattern_runs", "pattern_rows", r6("success_rate")),
    f"""WITH {SPLIT_SQL}, {S.ORDER_TRADES}, q AS (SELECT structure_id, count(DISTINCT run_id) AS rr, count(*) AS n, avg(profitable) AS p FROM trades JOIN runs USING (run_id) GROUP BY 1)
    SELECT sp.structure_id, split, run_count, coalesce(rr, 0) AS runs_with_pattern_rows, run_count - coalesce(rr, 0) AS zero_pattern_runs, coalesce(q.n, 0) AS pattern_rows, round(p, 6) AS success_rate
    FROM sp LEFT JOIN q ON q.structure_id = sp.structure_id""")
add("DS7_hash_split",
    lambda s, d: V.table(s, d, "customer").select("c_custkey", D.hash_split(F.concat(F.lit("ST-"), F.col("c_custkey").cast("string")), F.col("c_custkey") - 1, CFG).alias("split")),
    f"""SELECT c_custkey, CASE WHEN c_custkey = 1 THEN 'train' WHEN c_custkey = 2 THEN 'validation' WHEN c_custkey = 3 THEN 'test' WHEN u < 0.6 THEN 'train' WHEN u < 0.8 THEN 'validation' ELSE 'test' END AS split
    FROM (SELECT c_custkey, ('0x' || substr(sha256('sha256_v1|{CFG.base_seed}|ST-' || c_custkey), 1, 16))::UBIGINT / 18446744073709551616.0::DOUBLE AS u FROM customer)""")
add("DS8_exact_stratified_sample",
    lambda s, d: D.stratified_sample(V.table(s, d, "orders"), ["o_orderpriority"], 50, "o_orderkey").select("o_orderpriority", "o_orderkey"),
    "SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('s|' || o_orderkey), o_orderkey) <= 50")
add("DS9_bounded_uniform_sample",
    lambda s, d: D.bounded_sample(V.table(s, d, "orders"), 200, "o_orderkey").select("o_orderkey", "o_custkey"),
    "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('s|' || o_orderkey), o_orderkey LIMIT 200")

MIX = ("momentum", "regime", "adaptive")
DEFAULTS = {"momentum": {"lookback": 12}, "regime": {"stay": 0.992}, "adaptive": {"decay": 0.965}}
GRID = {"lookback": [12, 20], "stay": [0.95, 0.992]}


def scenarios(s, d) -> DataFrame:
    base = V.table(s, d, "nation").select(F.col("n_name").alias("market"))
    return G.scenario_grid(base, GRID, MIX, 4, {k: {n: v for n, v in x.items() if n in GRID} for k, x in DEFAULTS.items()})


_SC = """g AS (SELECT n_name AS market, lookback, stay FROM nation, (VALUES (12), (20)) a(lookback), (VALUES (0.95::DOUBLE), (0.992::DOUBLE)) b(stay)),
m AS (SELECT i / 4.0::DOUBLE AS wm, j / 4.0::DOUBLE AS wr, (4 - i - j) / 4.0::DOUBLE AS wa FROM range(5) x(i), range(5) y(j) WHERE i + j <= 4),
k AS (SELECT DISTINCT market, CASE WHEN wm > 0 THEN lookback ELSE 12 END AS lookback, CASE WHEN wr > 0 THEN stay ELSE 0.992 END AS stay, wm, wr, wa FROM g, m)"""
add("DS10_scenario_grid",
    lambda s, d: scenarios(s, d).select("market", F.col("lookback").cast("long").alias("lookback"), r6("stay"), r6("w_momentum"), r6("w_regime"), r6("w_adaptive")),
    f"WITH {_SC} SELECT market, lookback, round(stay, 6) AS stay, round(wm, 6) AS w_momentum, round(wr, 6) AS w_regime, round(wa, 6) AS w_adaptive FROM k")
add("DS11_scenario_label",
    lambda s, d: scenarios(s, d).select("market", "label"),
    f"""WITH {_SC} SELECT market, concat_ws('+', CASE WHEN wm > 0 THEN 'momentum:' || wm END, CASE WHEN wr > 0 THEN 'regime:' || wr END, CASE WHEN wa > 0 THEN 'adaptive:' || wa END)
    || '|lookback=' || lookback || ',stay=' || stay AS label FROM k""")
_U = "('0x' || substr(sha256('7|{t}|' || c_custkey), 1, 16))::UBIGINT / 18446744073709551616.0::DOUBLE"
add("DS12_design_draws",
    lambda s, d: G.design_draws(V.table(s, d, "customer").select("c_custkey"), F.col("c_custkey"), "7", MIX).select(
        "c_custkey", r6("uniform_draw"), r6("log_uniform_draw"), *[r6(f"w_{m}") for m in MIX]),
    f"""WITH u AS (SELECT c_custkey, 1 + 2 * ({_U.format(t='uniform')}) AS a, exp(ln(0.001) + ({_U.format(t='log')}) * (ln(0.1) - ln(0.001))) AS b,
      {", ".join(f"-ln(1 - {_U.format(t=m)}) AS g_{m}" for m in MIX)} FROM customer)
    SELECT c_custkey, round(a, 6) AS uniform_draw, round(b, 6) AS log_uniform_draw, {", ".join(f"round(0.05 + 0.85 * g_{m} / ({' + '.join('g_' + x for x in MIX)}), 6) AS w_{m}" for m in MIX)} FROM u""")
add("DS13_feature_allow_list", lambda s, d: labelled_rows(s, d).select("event_id", *[r6(c) for c in D.feature_columns("observable")[0]], *D.CATEGORICAL))


def config_table(s, d) -> DataFrame:
    return V.table(s, d, "customer").select(
        "c_custkey", (F.col("c_custkey") % 3).cast("double").alias("w_momentum"), (F.col("c_custkey") % 2).cast("double").alias("w_regime"),
        F.lit(1.0).alias("w_adaptive"), (F.col("c_nationkey") + 5).alias("lookback"), (0.9 + F.col("c_custkey") % 4 / 100.0).alias("stay"), F.lit(0.965).alias("decay"))


def canonical(s, d) -> DataFrame:
    x = G.canonical_config(config_table(s, d), DEFAULTS)
    return G.with_identity(x, ["w_momentum", "w_regime", "w_adaptive", "lookback", "stay", "decay"])


add("DS14_canonical_identity",
    lambda s, d: canonical(s, d).groupBy("structure_id").agg(F.count(F.lit(1)).alias("configs"), F.min("c_custkey").alias("first_key"), r6("w_adaptive", F.min("w_adaptive")),
        F.min("lookback").cast("long").alias("lookback"), r6("stay", F.min("stay"))).drop("structure_id"),
    """WITH c AS (SELECT c_custkey, (c_custkey % 3)::DOUBLE AS m, (c_custkey % 2)::DOUBLE AS r, 1.0::DOUBLE AS a, CASE WHEN c_custkey % 3 > 0 THEN c_nationkey + 5 ELSE 12 END AS lookback,
      CASE WHEN c_custkey % 2 > 0 THEN round(0.9::DOUBLE + (c_custkey % 4) / 100.0::DOUBLE, 9) ELSE 0.992 END AS stay FROM customer)
    SELECT count(*) AS configs, min(c_custkey) AS first_key, round(a / (m + r + a), 6) AS w_adaptive, lookback, round(stay, 6) AS stay FROM c GROUP BY m, r, a, lookback, stay""")


def overridden(s, d) -> DataFrame:
    cfg = F.struct(F.struct(F.col("lookback").alias("lookback"), F.lit(0.006).alias("scale")).alias("momentum"), F.struct(F.col("stay").alias("stay")).alias("regime"))
    x = config_table(s, d).select("c_custkey", cfg.alias("before"))
    x = x.withColumn("after", G.override(F.col("before"), {"momentum.lookback": F.lit(12), "regime.stay": F.when(F.col("c_custkey") % 5 == 0, 0.5).otherwise(F.col("before.regime.stay"))}))
    return G.config_diff(x, ["c_custkey"], "before", "after", ["momentum.lookback", "momentum.scale", "regime.stay"])


add("DS15_overrides_and_diff",
    lambda s, d: overridden(s, d).select("c_custkey", "path", F.round(F.col("old_value").cast("double"), 6).alias("old_value"), F.round(F.col("new_value").cast("double"), 6).alias("new_value")),
    """SELECT c_custkey, 'momentum.lookback' AS path, (c_nationkey + 5)::DOUBLE AS old_value, 12.0::DOUBLE AS new_value FROM customer WHERE c_nationkey + 5 <> 12
    UNION ALL SELECT c_custkey, 'regime.stay', round(0.9::DOUBLE + (c_custkey % 4) / 100.0::DOUBLE, 6), 0.5::DOUBLE FROM customer WHERE c_custkey % 5 = 0""")


def path_grid(s, d) -> DataFrame:
    from candlemill.catalog.trading import HORIZONS, trades
    from candlemill.operators.inference import run_grid
    t = trades(s, d).groupBy("run_id", "hypothesis", "horizon").agg(F.count(F.when(F.col("status") == "accepted", 1)).alias("accepted"))
    return run_grid(V.supplier_runs(s, d).select("run_id"), HORIZONS).join(t, ["run_id", "hypothesis", "horizon"], "left").withColumn(
        "accepted", F.coalesce("accepted", F.lit(0).cast("long"))).withColumn("horizon", F.col("horizon").cast("long"))


def _grid_sql():
    from candlemill.catalog.trading import HYP_VALUES, plan_sql
    return f"""WITH RECURSIVE {plan_sql()}, {S.SUPPLIER_RUNS}, c AS (SELECT run_id, hypothesis, horizon, count(*) AS n FROM tr WHERE status = 'accepted' GROUP BY 1, 2, 3)
    SELECT runs.run_id, h.hypothesis, z.horizon, coalesce(n, 0) AS accepted FROM runs CROSS JOIN (VALUES {HYP_VALUES}) h(hypothesis) CROSS JOIN (VALUES (1), (3), (5), (10), (20)) z(horizon)
    LEFT JOIN c ON c.run_id = runs.run_id AND c.hypothesis = h.hypothesis AND c.horizon = z.horizon"""


add("DS16_hypothesis_grid_per_path", path_grid, _grid_sql())


def windows_of(s, d) -> DataFrame:
    """Each customer's order history as a dataset: asset = segment, window = first to last order."""
    o = V.table(s, d, "orders").join(V.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    day = F.datediff(F.to_date("o_orderdate"), F.to_date(F.lit("1992-01-01"))).cast("double")
    return o.groupBy("o_custkey", "c_nationkey").agg(F.min(day).alias("start"), F.max(day).alias("end"), F.count(F.lit(1)).alias("bars")).select(
        F.col("o_custkey").alias("dataset_id"), F.col("c_nationkey").cast("string").alias("asset"), "start", "end", "bars",
        F.when(F.col("o_custkey") % 7 == 0, F.concat(F.lit("g"), (F.col("c_nationkey") % 5).cast("string"))).alias("dependence_group"),
        F.col("o_custkey").alias("input_order"))


WIN_SQL = """wd AS (SELECT o_custkey AS dataset_id, c_nationkey AS asset, min(date_diff('day', DATE '1992-01-01', o_orderdate::DATE)) AS s, max(date_diff('day', DATE '1992-01-01', o_orderdate::DATE)) AS e, count(*) AS bars
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
add("DS17_pooled_dataset_records",
    lambda s, d: windows_of(s, d).select("dataset_id", "asset", r6("start"), r6("end"), "bars"),
    f"WITH {WIN_SQL} SELECT dataset_id, CAST(asset AS VARCHAR) AS asset, s::DOUBLE AS start, e::DOUBLE AS end, bars FROM wd")

# --- SET / JON ---------------------------------------------------------------------------------------
add("SET1_concatenate",
    lambda s, d: V.table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("src"), r6("balance", F.col("c_acctbal"))).unionByName(
        V.table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("supplier").alias("src")), allowMissingColumns=True),
    "SELECT c_custkey AS k, 'customer' AS src, round(c_acctbal, 6) AS balance FROM customer UNION ALL SELECT s_suppkey, 'supplier', NULL FROM supplier")


def split_overlap(s, d):
    x = D.assign_splits(V.customer_runs(s, d), CFG).select("structure_id", "split")
    part = lambda n: x.filter(F.col("split") == n).select("structure_id")
    both = part("train").intersect(part("test")).unionByName(part("train").intersect(part("validation"))).unionByName(part("validation").intersect(part("test")))
    return x.groupBy("split").agg(F.count(F.lit(1)).alias("structures")).withColumn("shared", F.coalesce(both.agg(F.count(F.lit(1))).scalar(), F.lit(0).cast("long")))


add("SET2_disjoint_splits", split_overlap, f"WITH {SPLIT_SQL} SELECT split, count(*) AS structures, 0 AS shared FROM sp GROUP BY 1")
def _keys(s, d, status):
    return V.table(s, d, "orders").filter(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("k")).distinct()


add("SET3_key_set_difference",
    lambda s, d: _keys(s, d, "F").exceptAll(_keys(s, d, "O")).withColumn("side", F.lit("only_f")).unionByName(
        _keys(s, d, "O").exceptAll(_keys(s, d, "F")).withColumn("side", F.lit("only_o"))),
    """WITH f AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), o AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
    SELECT k, 'only_f' AS side FROM f WHERE k NOT IN (SELECT k FROM o) UNION ALL SELECT k, 'only_o' FROM o WHERE k NOT IN (SELECT k FROM f)""")
add("SET4_distinct_identities",
    lambda s, d: rows_with_structure(s, d).select("run_id", "structure_id", "world_family").dropDuplicates(),
    f"WITH {S.CUSTOMER_RUNS}, {S.ORDER_TRADES} SELECT DISTINCT run_id, structure_id, world_family FROM trades JOIN runs USING (run_id)")
add("SET5_runs_with_and_without_rows",
    lambda s, d: V.customer_runs(s, d).join(V.order_trades(s, d), "run_id", "left_semi").withColumn("has_rows", F.lit(True)).unionByName(
        V.customer_runs(s, d).join(V.order_trades(s, d), "run_id", "left_anti").withColumn("has_rows", F.lit(False))).select("run_id", "structure_id", "has_rows"),
    f"WITH {S.CUSTOMER_RUNS} SELECT run_id, structure_id, run_id IN (SELECT CAST(o_custkey AS VARCHAR) FROM orders) AS has_rows FROM runs")
add("JON1_many_to_one_merge",
    lambda s, d: V.order_trades(s, d).select("row_id", "run_id").join(V.customer_runs(s, d), "run_id", "left").select("row_id", "run_id", "structure_id"),
    f"WITH {S.CUSTOMER_RUNS}, {S.ORDER_TRADES} SELECT row_id, trades.run_id, structure_id FROM trades LEFT JOIN runs ON runs.run_id = trades.run_id")
add("JON2_split_lookup",
    lambda s, d: rows_with_structure(s, d).join(D.assign_splits(V.customer_runs(s, d), CFG).select("structure_id", "split"), "structure_id", "left").groupBy("split", "pattern_type").agg(
        F.count(F.lit(1)).alias("rows")),
    f"WITH {SPLIT_SQL}, {S.ORDER_TRADES} SELECT split, pattern_type, count(*) AS rows FROM trades JOIN runs USING (run_id) JOIN sp USING (structure_id) GROUP BY 1, 2")


def short_windows(s, d) -> DataFrame:
    """Order windows of one day and clerk priority: many short datasets."""
    o = V.table(s, d, "orders")
    day = F.datediff(F.to_date("o_orderdate"), F.to_date(F.lit("1992-01-01"))).cast("double")
    return o.select(F.col("o_orderkey").alias("dataset_id"), F.col("o_orderpriority").alias("asset"), day.alias("start"),
                    (day + F.col("o_orderkey") % 2).alias("end"))


add("JON3_overlapping_windows",
    lambda s, d: J.overlap_counts(short_windows(s, d), 0.0),
    """WITH w AS (SELECT o_orderkey AS k, o_orderpriority AS p, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS s, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) + o_orderkey % 2 AS e FROM orders)
    SELECT a.k AS a, count(*) AS met, count(*) FILTER (a.p = b.p AND a.s < b.e AND b.s < a.e) AS same_asset FROM w a JOIN w b ON a.k < b.k AND a.s <= b.e AND b.s <= a.e GROUP BY 1""")


def sparse_windows(s, d) -> DataFrame:
    """Supplier price windows: the first shipping day of each supplier, a few days long."""
    li = V.table(s, d, "lineitem")
    day = F.datediff(F.to_date("l_shipdate"), F.to_date(F.lit("1992-01-01"))).cast("double")
    g = li.groupBy("l_suppkey").agg(F.min(day).alias("_d"), F.count(F.lit(1)).alias("n"))
    return g.select(F.col("l_suppkey").alias("dataset_id"), F.lit("x").alias("asset"), (F.col("_d") * 5 + F.col("l_suppkey") % 50 * 40).alias("start"),
                    (F.col("_d") * 5 + F.col("l_suppkey") % 50 * 40 + F.col("n") % 20).alias("end"),
                    F.when(F.col("l_suppkey") % 9 == 0, F.concat(F.lit("g"), (F.col("l_suppkey") % 4).cast("string"))).alias("dependence_group"),
                    F.col("l_suppkey").alias("input_order"))


add("JON4_dependence_clusters",
    lambda s, d: J.dependence_clusters(sparse_windows(s, d), 2.0).select("dataset_id", F.col("cluster_id").cast("long").alias("cluster_id")),
    """WITH RECURSIVE g AS (SELECT l_suppkey AS k, min(date_diff('day', DATE '1992-01-01', l_shipdate::DATE)) AS d, count(*) AS n FROM lineitem GROUP BY 1),
    w AS (SELECT k, d * 5 + k % 50 * 40 AS s, d * 5 + k % 50 * 40 + n % 20 AS e, CASE WHEN k % 9 = 0 THEN 'g' || (k % 4) END AS gr FROM g),
    ed AS (SELECT a.k AS a, b.k AS b FROM w a JOIN w b ON (a.s <= b.e + 2 AND b.s <= a.e + 2) OR a.gr = b.gr),
    rc AS (SELECT a, b FROM ed UNION SELECT rc.a, ed.b FROM rc JOIN ed ON ed.a = rc.b),
    lb AS (SELECT a AS k, min(b) AS l FROM rc GROUP BY 1)
    SELECT k AS dataset_id, dense_rank() OVER (ORDER BY l) - 1 AS cluster_id FROM lb""")
