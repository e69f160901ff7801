"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by (source, exact token length). Each source's target is met with whole passes over
its documents plus a remaining budget; a bounded-knapsack dynamic program over the length counts decides how
many documents of each length take one more pass, and a seeded order picks which ones. Only ids, sources and
lengths are shuffled, never texts. The knapsack sees one row per distinct length of a source, never its documents.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from candlemill.functions.windows import bucketed_rank
from candlemill.llm.columns import n_words, pack, unpack

WEIGHTS = (5, 2, 1)
BUCKETS = 1024


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: ``source``, ``source_size`` and ``target``.

    ``sizes`` has ``source`` and ``size``. Sources in code-point order (null last) weigh ``weights`` in turn and
    share ``share`` of all sizes; a target stops at ``most`` times its source's size and the excess is shared
    again by weight. That fixed point is target = min(most * size, level * weight): with sources ordered by
    most * size / weight, the level is what the sources above the cut leave over. The two windows run over one
    row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    per = per.withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    per = per.withColumn("_at", F.col("_cap") / F.col("_w"))
    rising = Window.orderBy("_at", F.col("source").isNull(), "source")
    below = rising.rowsBetween(Window.unboundedPreceding, -1)
    rest = rising.rowsBetween(0, Window.unboundedFollowing)
    everyone = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    goal = F.least(F.lit(float(share)) * F.sum("source_size").over(everyone), F.sum("_cap").over(everyone))
    per = per.withColumn("_level", (goal - F.coalesce(F.sum("_cap").over(below), F.lit(0.0))) / F.sum("_w").over(rest))
    # the first source (in rising order) whose own bound is above the level fixes it for all later ones
    per = per.withColumn("_open", F.col("_level") < F.col("_at"))
    level = F.min(F.when(F.col("_open"), F.struct("_at", "_level"))).over(everyone)["_level"]
    return per.select("source", "source_size", F.coalesce(F.least(F.col("_cap"), level * F.col("_w")), F.col("_cap")).alias("target"))


def fit_budget(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take so that the lengths add up to ``budget``, or as near below as
    they can get.

    First every length takes its proportional share, which keeps the mix of lengths. What is left is cut down
    by single documents, longest first, to less than twice the longest one. The rest is an exact bounded
    knapsack: reachable sums are bits of an integer, each length with its remaining count split into powers of
    two, short lengths last; the walk back over the stored bit sets tells the counts.
    """
    total = sum(x * n for x, n in zip(lengths, counts))
    if budget <= 0 or total <= 0:
        return [0] * len(lengths)
    if budget >= total:
        return list(counts)
    taken = [n * budget // total for n in counts]
    left = budget - sum(x * k for x, k in zip(lengths, taken))
    order = sorted((i for i in range(len(lengths)) if lengths[i] > 0), key=lambda i: -lengths[i])
    spare = 2 * lengths[order[0]]
    for i in order:
        if left <= spare:
            break
        more = min(counts[i] - taken[i], (left - spare) // lengths[i] + 1, left // lengths[i])
        taken[i] += more
        left -= more * lengths[i]
    mask, reach, steps = (1 << (left + 1)) - 1, 1, []
    for i in reversed(order):
        free, power = min(counts[i] - taken[i], left // lengths[i]), 1
        while free > 0 and not reach >> left & 1:
            part = min(power, free)
            steps.append((i, part, reach))
            reach |= reach << part * lengths[i] & mask
            free, power = free - part, power * 2
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for i, part, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += part
            at -= part * lengths[i]
    return taken


def _fit(source: pd.DataFrame) -> pd.DataFrame:
    source = source.sort_values("size")
    target, whole = source["target"].iloc[0], int(source["source_size"].iloc[0])
    passes = int(target // whole) if whole else 0
    extra = fit_budget(source["size"].tolist(), source["n"].tolist(), int(round(target - passes * whole)))
    return pd.DataFrame({
        "source": source["source"], "size": source["size"], "source_size": whole, "target": float(target), "passes": passes, "extra": extra})


def _mixed(
    docs: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: Sequence[float] = WEIGHTS,
    share: float = 1.5, most: float = 2.0, seed: int = 7, length: Column | None = None,
) -> DataFrame:
    """The rows of ``docs``, packed, with ``size``, ``source_size``, ``target`` and ``copies``."""
    base = pack(
        docs, source=F.col(source), size=F.coalesce(length if length is not None else n_words(F.col(text)), F.lit(0)).cast("long"),
        draw=F.xxhash64(F.col(doc_id), F.lit(seed)), id=F.col(doc_id))
    counted = base.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    targets = source_targets(counted.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, most)
    counted = counted.alias("c").join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.*", "t.source_size", "t.target")
    plan = counted.groupBy("source").applyInPandas(_fit, "source string, size long, source_size long, target double, passes long, extra long")
    # documents of a length are picked by the rank of their draw; a hot length is ranked in buckets of the draw
    base = base.withColumn("bucket", F.shiftrightunsigned(F.col("draw").bitwiseXOR(F.lit(-(2**63))), 65 - BUCKETS.bit_length()))
    met = F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size"))
    out = base.alias("d").join(plan.alias("p"), met).select(
        "_row", "d.size", "d.draw", "d.id", "d.bucket", F.concat(F.lit("="), "d.source").alias("key"), "p.source_size", "p.target", "p.passes", "p.extra")
    out = bucketed_rank(out.fillna("", ["key"]), ["key", "size"], "bucket", ["draw", "id"], name="rank")
    copies = (F.col("passes") + F.when(F.col("rank") <= F.col("extra"), 1).otherwise(0)).cast("long")
    return out.select("_row", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """All rows of ``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (size * copies).

    Null texts and texts without words have size 0 and are never taken (copies is the whole number of passes).
    Null sources form one source, the last. Repeated rows count and are picked one by one; rows that agree in
    id, source and length are interchangeable, so that a rerun gives the same result. Columns of these names
    in ``docs`` are replaced. An empty table gives an empty result. Options: names of the columns ``text``, ``source`` and
    ``doc_id``, ``weights``, ``share``, ``most``, ``seed`` and a ``length`` column in place of the number of words.
    """
    out = _mixed(docs, **options)
    named = {c: F.col(c) for c in ("size", "source_size", "target", "copies")}
    return unpack(out, docs.columns, **named, taken=F.col("size") * F.col("copies"))


def _repeated(packed: DataFrame, columns: list[str], copies: str, size: str) -> DataFrame:
    taken = packed.filter((F.col(copies) > 0) & (F.col(size) > 0))
    return unpack(taken.select("_row", F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))), columns)


def take(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`mix` takes it, with the columns of ``docs``, whatever their names.

    Null texts and texts without words are never taken; an empty table gives an empty result.
    """
    return _repeated(_mixed(docs, **options), docs.columns, "copies", "size")


def mixed_rows(mixed: DataFrame) -> DataFrame:
    """The same from the rows of :func:`mix`, without the columns it has set."""
    names = [c for c in mixed.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    return _repeated(pack(mixed, size=F.col("size"), copies=F.col("copies")), names, "copies", "size")
