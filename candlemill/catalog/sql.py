"""Shared SQL text of the oracle: the same views, written for DuckDB over the raw tables."""

TICKS = """
ev0 AS (SELECT event_type AS run_id, ts, event_id, user_id, value,
          CAST(round(value * 100) AS BIGINT) AS cents,
          row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS step FROM events),
ev1 AS (SELECT *, sum(cents % 100 - 50) OVER (PARTITION BY run_id ORDER BY step) AS drift,
          0.0005::DOUBLE * (1 + user_id % 3) AS half_spread, value + 1.0::DOUBLE AS price,
          1 + event_id % 10 AS volume, user_id % 2 AS side, 1 + event_id % 3 AS trade_count FROM ev0),
ev2 AS (SELECT *, round(100.0::DOUBLE * exp(0.0002::DOUBLE * drift), 9) AS walk,
          CASE WHEN side = 1 THEN volume ELSE 0 END AS buy_volume,
          CASE WHEN side = 0 THEN volume ELSE 0 END AS sell_volume FROM ev1),
ticks AS (SELECT *, walk * (1 - half_spread) AS bid, walk * (1 + half_spread) AS ask,
          buy_volume - sell_volume AS signed_order_flow,
          CASE WHEN event_id % 11 = 0 THEN 0.0 ELSE walk * (1 - half_spread) END AS post_bid,
          CASE WHEN event_id % 11 = 0 THEN 0.0 ELSE walk * (1 + half_spread) END AS post_ask FROM ev2)"""

# Five ticks per bar on the walk price, partial tail dropped, with execution columns.
BARS5 = TICKS + """,
b0 AS (SELECT run_id, step // 5 AS bar_index, min(step) AS start_step, max(step) AS end_step,
         arg_min(walk, step) AS open, max(walk) AS high, min(walk) AS low, arg_max(walk, step) AS close,
         CAST(sum(volume) AS BIGINT) AS volume, count(*) AS tick_count,
         arg_min(bid, step) AS bid0, arg_min(ask, step) AS ask0,
         arg_max(post_bid, step) AS pb, arg_max(post_ask, step) AS pa,
         arg_max(bid, step) AS bid1, arg_max(ask, step) AS ask1, arg_max(walk, step) AS ref1
       FROM ticks GROUP BY 1, 2),
bars AS (SELECT run_id, bar_index, bar_index + 1 AS candle_number, start_step, end_step, open, high, low, close,
         volume, tick_count, 0.5 * bid0 + 0.5 * ask0 AS entry_mid,
         CASE WHEN pb > 0 THEN 0.5 * pb + 0.5 * pa ELSE ref1 END AS exit_mid,
         (ask0 - bid0) / (0.5 * bid0 + 0.5 * ask0) AS entry_spread,
         CASE WHEN pb > 0 THEN (pa - pb) / (0.5 * pb + 0.5 * pa) ELSE greatest(0, (ask1 - bid1) / ref1) END AS exit_spread
       FROM b0 WHERE tick_count = 5)"""

# One event tick per bar.
WALK = TICKS + """,
bars AS (SELECT run_id, step AS bar_index, walk AS open, ask AS high, bid AS low, walk AS close, volume,
         walk AS entry_mid, walk AS exit_mid, 2 * half_spread AS entry_spread, 2 * half_spread AS exit_spread FROM ticks)"""

# One supplier tick per bar.
LI = """
li0 AS (SELECT CAST(l_suppkey AS VARCHAR) AS run_id, l_orderkey, l_extendedprice / l_quantity AS price,
          CAST(l_quantity AS BIGINT) AS volume, 0.0005::DOUBLE * (1 + l_orderkey % 3) AS half_spread,
          row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS step
        FROM lineitem),
bars AS (SELECT run_id, step AS bar_index, price AS open, price * (1 + half_spread) AS high,
          price * (1 - half_spread) AS low, price AS close, volume, price AS entry_mid, price AS exit_mid,
          2 * half_spread AS entry_spread, 2 * half_spread AS exit_spread FROM li0)"""

SUPPLIER_RUNS = """
runs AS (SELECT CAST(s_suppkey AS VARCHAR) AS run_id, s_suppkey AS seed, n_name AS structure_id,
           CASE WHEN n_nationkey % 5 = 0 THEN 'null_strict' ELSE 'structured' END AS world_family
         FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

CUSTOMER_RUNS = """
runs AS (SELECT CAST(c_custkey AS VARCHAR) AS run_id, n_name AS structure_id,
           CASE WHEN n_nationkey % 5 = 0 THEN 'null_strict' ELSE 'structured' END AS world_family
         FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

ORDER_TRADES = """
ot0 AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS step FROM orders),
trades AS (SELECT o_orderkey AS row_id, CAST(o_custkey AS VARCHAR) AS run_id, 'EV-' || o_orderkey AS event_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'head_and_shoulders' WHEN '2-HIGH' THEN 'rectangle'
      WHEN '3-MEDIUM' THEN 'symmetrical_triangle' WHEN '4-NOT SPECIFIED' THEN 'double_top'
      WHEN '5-LOW' THEN 'double_bottom' ELSE 'broadening_formation' END AS pattern_type,
    CASE WHEN o_orderkey % 3 = 0 THEN 'bearish' ELSE 'bullish' END AS trade_direction,
    step // 2 AS entry_index, step // 2 + o_orderkey % 4 AS exit_index,
    (o_orderkey * 7 % 20) / 20.0::DOUBLE AS probability,
    (o_totalprice - 250000) / 1e7::DOUBLE AS net_directional_return,
    CASE WHEN (o_totalprice - 250000) / 1e7::DOUBLE > 0 THEN 1 ELSE 0 END AS profitable FROM ot0)"""

SCORES = """
scores AS (SELECT event_id AS row_id, least(value / 500.0::DOUBLE, 1.0::DOUBLE) AS probability,
   CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label FROM events)"""


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) AS {name}"


def pick(columns, digits: int = 6) -> str:
    return ", ".join(r(c, c, digits) for c in columns)
