"""Control pools, and joins of tables that grow, without large broadcasts."""

from pyspark.sql import functions as F

from candlemill.operators import controls as N
from candlemill.sources.series import sorted_join


def signals(spark):
    return spark.createDataFrame([("a", i) for i in (2, 5, 6, 40, 41, 4090, 4100, 4200, 9000)] + [("b", 30)], "run_id string, entry_index long")


def test_forbidden_entries_come_once_each(spark):
    horizons, embargo = [1, 5, 20], 3
    got = [tuple(r) for r in N.forbidden_entries(signals(spark), horizons, embargo).select("run_id", "horizon", "entry_index").collect()]
    want = {(r.run_id, h, i) for r in signals(spark).collect() for h in horizons
            for i in range(max(0, r.entry_index - h + 1 - embargo), r.entry_index + h + embargo)}
    assert len(got) == len(set(got)) and set(got) == want


def test_control_pool_is_what_signals_leave_even_one_due_after_the_last_bar(spark):
    last = {"a": 9000, "b": 30}  # the last signal of each run is due on the bar after its last one
    states = spark.createDataFrame([(r, i, 0.1, 0.2) for r, n in last.items() for i in range(n)], "run_id string, bar_index long, trailing_vol double, entry_spread double")
    counts = states.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_bars"))
    horizons, embargo = [1, 20], 4
    pool = N.control_pool(states, counts, signals(spark), horizons, [1, 8], embargo)
    got = [tuple(r) for r in pool.select("run_id", "horizon", "min_entry", "entry_index").collect()]
    at = {}
    for r in signals(spark).collect():
        at.setdefault(r.run_id, []).append(r.entry_index)
    want = {(r, h, m, i) for r, n in last.items() for h in horizons for m in (1, 8) for i in range(m, n - h + 1)
            if all(abs(i - p) > h - 1 + embargo for p in at[r])}
    assert len(got) == len(set(got)) and set(got) == want


def test_exploded_tables_are_not_broadcast(spark):
    few = spark.range(10).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(50))).alias("at"))
    plan = sorted_join(spark.range(100).withColumnRenamed("id", "k"), few, "k")
    assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()
