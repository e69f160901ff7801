"""Dependence clusters of datasets: overlapping time windows and declared groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from candlemill.functions.windows import bucketed_scan
from candlemill.sources.series import ordered, sorted_join, written


def overlap_pairs(windows: DataFrame, embargo: float, *, width: float) -> DataFrame:
    """Pairs of datasets whose [start, end] windows meet within the embargo.

    A range join on time buckets: each widened window is listed in the buckets it covers and a pair
    is kept only in the bucket of its first shared instant, so no full cross product is formed.
    """
    lo, hi = F.col("start") - embargo, F.col("end")
    bucket = lambda x: F.floor(x / width).cast("long")
    a = windows.select(F.col("dataset_id").alias("a"), F.col("asset").alias("asset_a"), F.col("start").alias("sa"), F.col("end").alias("ea"),
                       F.explode(F.sequence(bucket(lo), bucket(hi))).alias("_b"))
    b = windows.select(F.col("dataset_id").alias("b"), F.col("asset").alias("asset_b"), F.col("start").alias("sb"), F.col("end").alias("eb"),
                       F.explode(F.sequence(bucket(lo), bucket(hi))).alias("_b"))
    met = (F.col("sa") <= F.col("eb") + embargo) & (F.col("sb") <= F.col("ea") + embargo)
    home = bucket(F.greatest(F.col("sa"), F.col("sb")) - embargo)
    return a.join(b, "_b").filter((F.col("a") < F.col("b")) & met & (F.col("_b") == home)).select(
        "a", "b", ((F.lower("asset_a") == F.lower("asset_b")) & (F.col("sa") < F.col("eb")) & (F.col("sb") < F.col("ea"))).alias("same_asset_overlap"))


def above_before(k: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each place the summed ``n`` of earlier places with a larger ``k``, bit by bit of the place."""
    out, place = np.zeros(len(k), dtype=np.int64), np.arange(len(k))
    order = np.lexsort((-place, -k))  # of equal k the later place first, so that it does not count the earlier one
    for bit in reversed(range(max(len(k) - 1, 0).bit_length())):
        group, right = order >> (bit + 1), (order >> bit & 1).astype(bool)
        left = np.cumsum(np.where(right, 0, n[order]))
        first = np.searchsorted(group, group)
        out[order[right]] += (left - np.where(first > 0, left[first - 1], 0))[right]
        order = order[np.argsort(order >> bit, kind="stable")]
    return out


# Coordinates of the four counts behind overlap_counts: whether by asset, the window's own place (even) and what it asks for (odd).
# A coordinate is (value, turn); a question counts the places below it.
_TURNS = ((False, "start", 0, "end", 3), (False, "end", 2, "start", 1), (True, "start", 2, "end", 1), (True, "end", 0, "start", 1))


def _asked(embargo: float) -> list[tuple[Column, Column, Column, Column]]:
    """Per count: asset, value and turn of the own place, value and turn of the question."""
    none, point = F.lit(None).cast("string"), F.col("start") == F.col("end")
    out = []
    for by, own, turn, ask, asks in _TURNS:
        shift = 0.0 if by else embargo if ask == "end" else -embargo
        moves = F.when(point, 0) if by and own == "end" else None
        mine, wants = F.lit(turn), F.lit(asks)
        if moves is not None:  # two equal windows of no length do not overlap, so such a question comes before such a place
            mine, wants = F.when(point, 2).otherwise(0), F.when(point, 1).otherwise(3)
        out.append((F.col("asset") if by else none, F.col(own), mine, F.col(ask) + shift, wants))
    return out


def overlap_counts(windows: DataFrame, embargo: float, *, block: int = 1 << 18, part: int = 1 << 16) -> DataFrame:
    """Per dataset the number of pairs of :func:`overlap_pairs` in which it is ``a``, and of those with ``same_asset_overlap``; none, no row.

    No pair is formed. A window meets the later ids that start before its end, less those that end before its start; both are
    counts over two orders (ids and instants). Ids are cut in blocks, distinct instants of a block in parts: whole blocks in
    whole parts come from a table of running sums, the rest is counted inside one part and inside one block. Ids are unique.
    """
    if embargo < 0:
        raise ValueError("the embargo must not be negative")
    rows = windows.select("dataset_id", F.lower("asset").alias("asset"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end")).dropna(
        subset=["dataset_id", "start", "end"])
    cut = lambda size: F.col("_pid") * (1 << 24) + F.floor(F.col("_pos") / size)
    x = ordered(rows, ["dataset_id"]).withColumn("block", cut(block).cast("long"))
    if x.filter(F.col("end") < F.col("start")).limit(1).count():
        raise ValueError("a window ends before it starts")
    coordinate = ["sys", "asset", "x", "turn"]
    pick = lambda i, a, v, t: F.struct(F.lit(i).alias("sys"), a.alias("asset"), v.alias("x"), t.alias("turn"))
    both = [pick(i, a, v, t) for i, (a, own, mine, ask, wants) in enumerate(_asked(embargo)) for v, t in ((own, mine), (ask, wants))]
    u = x.select("block", F.explode(F.array(*both)).alias("c")).groupBy("block", "c").agg(F.count(F.lit(1)).alias("n")).select("block", "c.*", "n")
    u = ordered(u, coordinate).withColumn("part", cut(part).cast("long")).drop("_pid")
    places, asks = F.col("turn") % 2 == 0, F.col("turn") % 2 == 1
    # Running sums over whole blocks and parts; the table has a row for each pair of a block and a part.
    blocks = x.groupBy("block").agg(F.count(F.lit(1)).alias("_n"))
    cells = u.filter(places).groupBy("part", "block").agg(F.sum("n").alias("n"))
    cells = u.select("part").distinct().crossJoin(blocks.select("block")).join(cells, ["part", "block"], "left")
    upper = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lower = F.coalesce(F.sum("_u").over(Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("_u", upper).select("part", "block", lower.alias("whole"))

    def inside(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("_pos")
        own = np.where(p["turn"] % 2 == 0, p["n"], 0)
        p = p.assign(c=above_before(p["block"].to_numpy(), own))
        return p.loc[p["turn"] % 2 == 1, ["part", "block", *coordinate, "c"]]

    part_sums = u.groupBy("part").applyInPandas(inside, "part long, block long, sys int, asset string, x double, turn int, c long")
    beyond = sorted_join(part_sums, cells, ["part", "block"]).select("block", *coordinate, (F.col("c") + F.col("whole")).alias("c"))
    # Each count also meets the places of the counts before it, as many as there are windows: two neighbours differ by one such sum.
    later = F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.join(blocks.select("block", later.alias("_later")), "block")
    x = x.select("block", "dataset_id", "asset", "_pos", "_later", *[c.alias(f"{n}{i}") for i, a in enumerate(_asked(embargo)) for n, c in zip(("v", "t", "q", "w"), a[1:])])

    def in_block(p: pd.DataFrame, far: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("_pos").reset_index(drop=True)
        names, _ = pd.factorize(pd.concat([p["asset"], far["asset"]]), use_na_sentinel=False)
        mine, theirs, m = names[: len(p)], names[len(p) :], len(p)
        got = []
        for i, (by, *_) in enumerate(_TURNS):
            asset = mine if by else np.zeros(m, dtype=np.int64)
            values, turns = np.concatenate([p[f"v{i}"], p[f"q{i}"]]), np.concatenate([p[f"t{i}"], p[f"w{i}"]])
            order = np.lexsort((turns, values, np.concatenate([asset, asset])))
            near = np.empty(2 * m, dtype=np.int64)
            near[order] = above_before(np.tile(np.arange(m), 2)[order], (order < m).astype(np.int64))
            here = (far["sys"] == i).to_numpy()
            table = pd.DataFrame({"a": theirs[here] if by else 0, "x": far["x"].to_numpy()[here], "t": far["turn"].to_numpy()[here], "c": far["c"].to_numpy()[here]})
            asked = pd.DataFrame({"a": asset, "x": p[f"q{i}"], "t": p[f"w{i}"]}).merge(table, how="left", on=["a", "x", "t"], validate="m:1")
            got.append(near[m:] + asked["c"].to_numpy(dtype=np.int64))
        met, same = got[0] - got[1] + p["_later"], got[2] - got[3] + p["_later"]
        return pd.DataFrame({"a": p["dataset_id"], "met": met, "same_asset": np.where(p["asset"].isna(), 0, same)})

    kind = rows.schema["dataset_id"].dataType.simpleString()
    out = x.groupBy("block").cogroup(beyond.groupBy("block")).applyInPandas(in_block, f"a {kind}, met long, same_asset long")
    return out.filter("met > 0")


def interval_islands(windows: DataFrame, embargo: float) -> DataFrame:
    """Transitive clusters of overlapping windows: a running maximum of ends over ranges of equal row numbers."""
    place = ["_pos"]
    x = ordered(windows, ["start", "end", "dataset_id"])
    x = bucketed_scan(x, [], "_pid", place, {"_reach": ("max", "end")}, exclusive=True)
    x = x.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + embargo), 1).otherwise(0))
    x = bucketed_scan(x, [], "_pid", place, {"cluster": ("sum", "_new")})
    return x.withColumn("cluster", F.col("cluster") - 1).drop("_pid", "_pos", "_reach", "_new")


def dependence_clusters(windows: DataFrame, embargo: float) -> DataFrame:
    """Clusters joined by time overlap or by a shared ``dependence_group``.

    Interval islands come first; islands that share a group are then merged by passing on the
    smallest label until nothing changes. Labels are renumbered by first appearance.
    """
    x = written(interval_islands(windows, embargo).withColumn("label", F.col("cluster").cast("long")), "islands")
    while True:
        groups = x.filter(F.col("dependence_group").isNotNull()).groupBy("dependence_group").agg(F.min("label").alias("_g"))
        y = x.join(groups, "dependence_group", "left").withColumn("_m", F.least("label", F.coalesce("_g", F.col("label"))))
        down = y.groupBy("cluster").agg(F.min("_m").alias("_n"))
        z = written(y.drop("_g", "_m").join(down, "cluster").withColumn("_moved", F.col("_n") < F.col("label")).withColumn("label", F.col("_n")).drop("_n"), "labels")
        moved = z.filter("_moved").limit(1).count()
        x = z.drop("_moved")
        if not moved:
            break
    names = ordered(x.groupBy("label").agg(F.min("input_order").alias("first_seen")), ["first_seen"]).withColumn("_one", F.lit(1))
    names = bucketed_scan(names, [], "_pid", ["_pos"], {"cluster_id": ("sum", "_one")}).select("label", (F.col("cluster_id") - 1).alias("cluster_id"))
    return x.drop("cluster").join(names, "label").drop("label")
