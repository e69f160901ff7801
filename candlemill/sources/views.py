"""Price-like views over the driver tables (column formulas only; no data is made up)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from candlemill.functions.columns import half_away
from candlemill.sources.series import number_series, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_walk() -> Column:
    """Walk price of :func:`event_ticks` before it is rounded; on long runs the rounded one falls to zero, this one stays positive."""
    return 100.0 * F.exp(0.0002 * F.col("drift"))


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of the ``events`` table: one run per event type."""

    def build() -> DataFrame:
        ev = table(spark, sf_dir, "events").select(
            F.col("event_type").alias("run_id"), "ts", "event_id", "user_id", "value",
            F.round(F.col("value") * 100).cast("long").alias("cents"),
        ).withColumn("move", F.col("cents") % 100 - 50)
        return number_series(ev, "run_id", ["ts", "event_id"], running={"drift": "move"})

    base = stored(spark, ("events", sf_dir), build)
    half = 0.0005 * (1 + F.col("user_id") % 3)
    price = F.col("value") + 1.0
    walk = half_away(exact_walk(), 9)  # the last bit of exp differs between engines
    return (
        base.withColumns({
            "half_spread": half,
            "price": price,
            "walk": walk,
            "volume": 1 + F.col("event_id") % 10,
            "side": F.col("user_id") % 2,
        })
        .withColumns({
            "bid": F.col("walk") * (1 - F.col("half_spread")),
            "ask": F.col("walk") * (1 + F.col("half_spread")),
            "buy_volume": F.when(F.col("side") == 1, F.col("volume")).otherwise(F.lit(0)),
            "sell_volume": F.when(F.col("side") == 0, F.col("volume")).otherwise(F.lit(0)),
            "trade_count": 1 + F.col("event_id") % 3,
        })
        .withColumns({
            "signed_order_flow": F.col("buy_volume") - F.col("sell_volume"),
            "post_bid": F.when(F.col("event_id") % 11 == 0, F.lit(0.0)).otherwise(F.col("bid")),
            "post_ask": F.when(F.col("event_id") % 11 == 0, F.lit(0.0)).otherwise(F.col("ask")),
        })
    )


def lineitem_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of ``lineitem``: one run per supplier, unit price as price."""

    def build() -> DataFrame:
        li = table(spark, sf_dir, "lineitem").select(
            F.col("l_suppkey").cast("string").alias("run_id"),
            "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
        )
        return number_series(li, "run_id", ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"],
                             keep=["run_id", "l_orderkey", "l_quantity", "l_extendedprice"])

    base = stored(spark, ("lineitem", sf_dir), build)
    return base.select(
        "run_id", "step", "l_orderkey",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").cast("long").alias("volume"),
        (0.0005 * (1 + F.col("l_orderkey") % 3)).alias("half_spread"),
    )


def lineitem_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One supplier tick per bar."""
    t = lineitem_ticks(spark, sf_dir)
    return t.select(
        "run_id", F.col("step").alias("bar_index"),
        F.col("price").alias("open"), (F.col("price") * (1 + F.col("half_spread"))).alias("high"),
        (F.col("price") * (1 - F.col("half_spread"))).alias("low"), F.col("price").alias("close"),
        "volume",
        F.col("price").alias("entry_mid"), F.col("price").alias("exit_mid"),
        (2 * F.col("half_spread")).alias("entry_spread"), (2 * F.col("half_spread")).alias("exit_spread"),
    )


def walk_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event tick per bar on the walk price."""
    t = event_ticks(spark, sf_dir)
    return t.select(
        "run_id", F.col("step").alias("bar_index"),
        F.col("walk").alias("open"), F.col("ask").alias("high"), F.col("bid").alias("low"),
        F.col("walk").alias("close"), "volume",
        F.col("walk").alias("entry_mid"), F.col("walk").alias("exit_mid"),
        (2 * F.col("half_spread")).alias("entry_spread"), (2 * F.col("half_spread")).alias("exit_spread"),
    )


def supplier_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run universe of the lineitem series, kept whole even where a run gives no signal."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").cast("string").alias("run_id"),
        F.col("s_suppkey").cast("long").alias("seed"),
        F.col("n_name").alias("structure_id"),
        F.when(F.col("n_nationkey") % 5 == 0, F.lit("null_strict")).otherwise(F.lit("structured")).alias("world_family"),
    )


PATTERN_BY_PRIORITY = {
    # fixed values: stand-in pattern family for each order priority
    "1-URGENT": "head_and_shoulders",
    "2-HIGH": "rectangle",
    "3-MEDIUM": "symmetrical_triangle",
    "4-NOT SPECIFIED": "double_top",
    "5-LOW": "double_bottom",
}


def order_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored trade rows from ``orders``: run = customer, structure = nation."""

    def build() -> DataFrame:
        o = table(spark, sf_dir, "orders").select(
            F.col("o_custkey").cast("string").alias("run_id"), "o_orderdate", "o_orderkey", "o_totalprice",
            "o_orderpriority",
        )
        return number_series(o, "run_id", ["o_orderdate", "o_orderkey"])

    base = stored(spark, ("orders", sf_dir), build)
    names = F.create_map(*[F.lit(x) for pair in PATTERN_BY_PRIORITY.items() for x in pair])
    ret = (F.col("o_totalprice") - 250000) / 1e7
    return base.select(
        F.col("o_orderkey").alias("row_id"), "run_id",
        F.concat(F.lit("EV-"), F.col("o_orderkey").cast("string")).alias("event_id"),
        F.coalesce(names[F.col("o_orderpriority")], F.lit("broadening_formation")).alias("pattern_type"),
        F.when(F.col("o_orderkey") % 3 == 0, "bearish").otherwise("bullish").alias("trade_direction"),
        F.floor(F.col("step") / 2).cast("long").alias("entry_index"),
        (F.floor(F.col("step") / 2) + F.col("o_orderkey") % 4).cast("long").alias("exit_index"),
        ((F.col("o_orderkey") * 7 % 20) / 20.0).alias("probability"),
        ret.alias("net_directional_return"),
        F.when(ret > 0, 1).otherwise(0).cast("long").alias("profitable"),
    )


def customer_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").cast("string").alias("run_id"),
        F.col("n_name").alias("structure_id"),
        F.when(F.col("n_nationkey") % 5 == 0, F.lit("null_strict")).otherwise(F.lit("structured")).alias("world_family"),
    )


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored binary labels from ``events``."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("row_id"),
        F.least(F.col("value") / 500.0, F.lit(1.0)).alias("probability"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).cast("long").alias("label"),
    )
