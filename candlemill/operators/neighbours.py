"""Exact nearest neighbours in the plane through a packed tree of boxes.

Points of a group are numbered along a Z-order curve and cut into pages of a quarter of ``size``; pages are packed ``FAN`` to a box,
boxes again, until a group has one root page. Every place searched for descends level by level: the boxes it met so far give
a radius that surely holds ``size`` points, boxes beyond it go, the rest are replaced by their children. What is left
at the bottom are the few pages that can hold a neighbour, whatever the density, and the proof is the radius itself: no place
is ever joined with a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from candlemill.sources.series import number_series, sorted_join, written

FAN = 16
BITS = 26
SALTS = 16


def _spread_bits(x: Column) -> Column:
    """A zero bit before every bit of a number of at most 32 bits."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def z_order(u: Column, v: Column, bounds: tuple[float, float, float, float]) -> Column:
    """Place of (u, v) on a Z-order curve over the rectangle of ``bounds`` (least u, greatest u, least v, greatest v)."""
    top = float((1 << BITS) - 1)
    codes = []
    for x, low, high in ((u, *bounds[:2]), (v, *bounds[2:])):
        share = (x - low) / (high - low) if high > low else F.lit(0.0)
        codes.append(_spread_bits(F.floor(share * top).cast("long")))
    return codes[0].bitwiseOR(F.shiftleft(codes[1], 1))


def _boxes(points: DataFrame, size: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels of boxes from the pages upwards, and the points with their page. A box: ``g``, ``node``, sides, ``held``."""
    u, v = F.col("u"), F.col("v")
    bounds = points.agg(F.min(u), F.max(u), F.min(v), F.max(v)).head()
    placed = points.withColumn("z", z_order(u, v, tuple(bounds)))
    paged = number_series(placed, "g", ["z", "id"], step="at").withColumn("node", F.floor(F.col("at") / max(4, size // 4)).cast("long")).drop("z", "at")
    sides = [F.min("u_low").alias("u_low"), F.max("u_high").alias("u_high"), F.min("v_low").alias("v_low"), F.max("v_high").alias("v_high"), F.sum("held").alias("held")]
    level = paged.select("g", "node", u.alias("u_low"), u.alias("u_high"), v.alias("v_low"), v.alias("v_high"), F.lit(1).alias("held")).groupBy("g", "node").agg(*sides)
    levels = [written(level, "boxes")]
    while (levels[-1].agg(F.max("node")).head()[0] or 0) >= FAN:
        up = levels[-1].withColumn("node", F.floor(F.col("node") / FAN).cast("long")).groupBy("g", "node").agg(*sides)
        levels.append(written(up, "boxes"))
    return levels, paged


def _within_reach(met: DataFrame, size: int) -> DataFrame:
    """Boxes that may hold one of the ``size`` nearest points of their place, with the radius that surely holds these.

    Boxes beyond the radius of the level above (``_reach``, if ``met`` has it) go before anything is sent on.
    """
    far = F.greatest(F.abs(F.col("pu") - F.col("u_low")), F.abs(F.col("pu") - F.col("u_high"))) + F.greatest(
        F.abs(F.col("pv") - F.col("v_low")), F.abs(F.col("pv") - F.col("v_high")))
    zero = F.lit(0.0)
    near = F.greatest(zero, F.col("u_low") - F.col("pu"), F.col("pu") - F.col("u_high")) + F.greatest(zero, F.col("v_low") - F.col("pv"), F.col("pv") - F.col("v_high"))
    place = Window.partitionBy("g", "pu", "pv")
    met = met.withColumns({"_far": far, "_near": near})
    if "_reach" in met.columns:
        met = met.filter(F.col("_reach").isNull() | (F.col("_near") <= F.col("_reach"))).drop("_reach")
    met = met.withColumn("_sum", F.sum("held").over(place.orderBy("_far", "node").rowsBetween(Window.unboundedPreceding, 0)))
    # Null where all boxes together hold fewer points: then every one stays.
    met = met.withColumn("_reach", F.min(F.when(F.col("_sum") >= size, F.col("_far"))).over(place))
    return met.filter(F.col("_reach").isNull() | (F.col("_near") <= F.col("_reach"))).select("g", "pu", "pv", "node", "_reach")


def nearest_points(points: DataFrame, places: DataFrame, size: int) -> DataFrame:
    """The ``size`` points of the same group nearest to every place by (|du| + |dv|, id), exactly.

    ``points``: g, id, u, v. ``places``: g, pu, pv (distinct). Result: g, pu, pv, id, distance, rank from 1. Of points at one
    spot only the ``size`` smallest ids can matter; the others are left out before anything is numbered.
    """
    spot = Window.partitionBy("g", "u", "v").orderBy("id")
    points = written(points.withColumn("_n", F.row_number().over(spot)).filter(F.col("_n") <= size).drop("_n"), "points")
    if not points.head(1):
        return places.select("g", "pu", "pv", F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("distance"), F.lit(1).alias("rank")).filter("false")
    levels, paged = _boxes(points, size)
    # The top level has at most FAN boxes a group: copies of it keep a group with many places apart.
    salt = F.pmod(F.xxhash64("pu", "pv"), F.lit(SALTS)).cast("int")
    top = levels[-1].withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = _within_reach(sorted_join(places.withColumn("_salt", salt), top, ["g", "_salt"]), size)
    for level in reversed(levels[:-1]):
        children = level.withColumn("_up", F.floor(F.col("node") / FAN).cast("long"))
        met = _within_reach(sorted_join(met.withColumnRenamed("node", "_up"), children, ["g", "_up"]), size)
    found = sorted_join(met, paged, ["g", "node"]).withColumn("distance", F.abs(F.col("u") - F.col("pu")) + F.abs(F.col("v") - F.col("pv")))
    found = found.filter(F.col("_reach").isNull() | (F.col("distance") <= F.col("_reach"))).drop("_reach")
    order = Window.partitionBy("g", "pu", "pv").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size).select("g", "pu", "pv", "id", "distance", "rank")

