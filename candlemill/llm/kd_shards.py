"""K-d tree sharding: distributed weighted medians along the widest metadata dimension.

The metadata of a row are functions of its text, so equal texts are one point. A node with k leaves is cut where its
bytes reach floor(k/2)/k of the node's, along the dimension in which the node is widest. The cut is found by
histogram refinement: one aggregation per refinement, for all nodes of a level at once, sums bytes by 2**BITS
buckets of the ordering key with map-side combine; only the bucket that holds the cut is refined. No row moves until the tree is
whole; then the tree is one nested CASE expression over each row's own columns.

Ordering key of a dimension: its value scaled to 24 bits, then 24 bits of the text's hash, then 12 bits of the id's
hash. Cuts fall between texts; only when the copies of the text at the cut weigh more than ``slack`` of a leaf is
the cut made inside that group, by id hash. So a group that holds a third of all rows is spread over leaves, and a
smaller one stays whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from candlemill.llm.columns import unpack, utf8
from candlemill.sources.series import number_series, written

DIM_BITS, TEXT_BITS, ID_BITS = 24, 24, 12
KEY_BITS = DIM_BITS + TEXT_BITS + ID_BITS
BITS = 12


@dataclass
class Node:
    first: int
    leaves: int
    dim: str = ""
    cut: int = 0
    left: "Node | None" = None
    right: "Node | None" = None


def _key(dim: str) -> Column:
    return (
        F.shiftleft(F.col(dim), TEXT_BITS + ID_BITS)
        .bitwiseOR(F.shiftleft(F.col("th"), ID_BITS))
        .bitwiseOR(F.col("ih")))


def _leaf(node: Node) -> Column:
    if node.leaves == 1 or node.left is None:
        return F.lit(node.first)
    return F.when(_key(node.dim) < F.lit(node.cut), _leaf(node.left)).otherwise(_leaf(node.right))


def _of_node(values: Mapping[int, int], shards: int) -> Column:
    """``values`` by ``node`` as one array literal, null at other nodes: data of the plan, no part of its generated code."""
    return F.get(F.array(*[F.lit(values.get(k)).cast("long") for k in range(shards)]), F.col("node"))


def _open_leaves(node: Node) -> list[Node]:
    return [node] if node.left is None else [*_open_leaves(node.left), *_open_leaves(node.right)]


def build_tree(meta: DataFrame, dims: list[str], shards: int, slack: float) -> Node:
    """The tree over ``meta`` (scaled dimensions, ``th``, ``ih``, ``size``). Each job brings back one row per node.

    Each row's node is written after a level. What differs between nodes and rounds stands in array literals, so that the
    driver compiles the jobs of one refinement for all levels once.
    """
    root = Node(0, shards)
    total = meta.agg(F.sum("size")).head()[0] or 0
    placed = meta.select("size", "th", "ih", *dims).withColumn("node", F.lit(0))
    while nodes := [n for n in _open_leaves(root) if n.leaves > 1]:
        by = {n.first: n for n in nodes}
        inner = placed.filter(_of_node({k: 1 for k in by}, shards).isNotNull())
        spans = inner.groupBy("node").agg(F.sum("size").alias("bytes"), *[(F.max(d) - F.min(d)).alias(d) for d in dims]).collect()
        spans = {r["node"]: r for r in spans}
        goal = {}
        for first, n in by.items():
            row = spans.get(first)
            n.dim = max(dims, key=lambda d: (row[d], -dims.index(d))) if row else dims[0]
            goal[first] = row["bytes"] * (n.leaves // 2) // n.leaves if row else 0
        along = _of_node({k: dims.index(n.dim) for k, n in by.items()}, shards)
        key = F.coalesce(*[F.when(along == i, _key(d)) for i, d in enumerate(dims)])
        keyed = inner.select("node", key.alias("key"), "size")
        low = {k: 0 for k in by}
        before = {k: 0 for k in by}
        todo, shift = set(by), KEY_BITS
        while todo:
            shift -= BITS
            # rows inside the bucket that holds the cut, so far known to its upper bits
            inside = F.shiftright("key", shift + BITS) == _of_node({k: low[k] >> (shift + BITS) for k in todo}, shards)
            sums = keyed.filter(inside).groupBy("node", F.shiftright("key", shift).alias("bucket")).agg(F.sum("size").alias("bytes"))
            up = Window.partitionBy("node").orderBy("bucket")
            start, want = _of_node(before, shards), _of_node(goal, shards)
            sums = sums.withColumn("upto", start + F.sum("bytes").over(up))
            hits = sums.filter(F.col("upto") > want).groupBy("node").agg(F.min(F.struct("bucket", "upto", "bytes")).alias("hit")).collect()
            hits = {r["node"]: r["hit"] for r in hits}
            for k in list(todo):
                if k not in hits:
                    todo.discard(k)
                    continue
                h = hits[k]
                low[k], before[k] = h["bucket"] << shift, h["upto"] - h["bytes"]
                whole_texts = shift <= ID_BITS
                if shift == 0 or whole_texts and h["bytes"] <= slack * total / shards:
                    # nearer side of the group at the cut
                    if h["upto"] - goal[k] < goal[k] - before[k]:
                        low[k] = (h["bucket"] + 1) << shift
                    todo.discard(k)
        for k, n in by.items():
            n.cut = low[k]
            n.left = Node(n.first, n.leaves // 2)
            n.right = Node(n.first + n.leaves // 2, n.leaves - n.leaves // 2)
        if any(n.leaves > 1 for n in _open_leaves(root)):
            cut, half = _of_node(low, shards), _of_node({k: n.leaves // 2 for k, n in by.items()}, shards)
            placed = written(placed.withColumn("node", F.when(key >= cut, F.col("node") + half.cast("int")).otherwise(F.col("node"))), "shard-nodes")
    return root


def text_dimensions(text: Column) -> dict[str, Column]:
    """Default metadata: length in bytes (log scale), bytes per character, words per byte, and the text's checksum."""
    size = F.octet_length(text).cast("double")
    return {
        "log_bytes": F.log2(size + 1),
        "bytes_per_char": F.coalesce(F.try_divide(size, F.char_length(text)), F.lit(0.0)),
        "spaces": F.coalesce(F.try_divide(size - F.octet_length(F.translate(text, " ", "")), size), F.lit(0.0)),
        "checksum": F.crc32(text.cast("binary")).cast("double"),
    }


def kd_shards(
    docs: DataFrame, shards: int, *, text: str = "text", doc_id: str = "doc_id", overhead: int = 8,
    dims: Mapping[str, Column] | None = None, slack: float = 0.02, keep: Sequence[str] | None = None,
) -> DataFrame:
    """All rows of ``docs`` (all columns, or those in ``keep``) with ``size``, ``text_crc32``, ``shard`` and ``slot``.

    Shards are the leaves 0 to ``shards`` - 1 of the tree, near equal in bytes (UTF-8 bytes plus ``overhead`` a row).
    ``slot`` numbers a shard's rows from 0 without gaps, by id, then checksum; rows that agree in both are
    interchangeable. Null texts count as empty. Null ids come first. Repeated rows and copies of a text are separate
    rows of one point. A dimension that is null or NaN somewhere counts as 0 there. Columns of the four names are
    replaced. An empty table gives an empty result.
    """
    filled = F.coalesce(F.col(text), F.lit(""))
    given = dict(dims) if dims is not None else text_dimensions(filled)
    raw = [f"d{i}" for i in range(len(given))]
    base = docs.select(
        F.col(doc_id).alias("id"), (F.octet_length(filled) + overhead).cast("long").alias("size"), F.crc32(utf8(F.col(text))).alias("crc"),
        F.shiftrightunsigned(F.xxhash64(filled), 64 - TEXT_BITS).alias("th"), F.shiftrightunsigned(F.xxhash64(F.col(doc_id), F.lit(1)), 64 - ID_BITS).alias("ih"),
        *[F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0)).alias(r) for r, c in zip(raw, given.values())])
    meta = written(base, "shard-metadata")
    ends = meta.agg(*[f(r).alias(f"{n}_{r}") for r in raw for n, f in (("lo", F.min), ("hi", F.max))]).head()
    steps = 2**DIM_BITS - 1

    def scaled(value: Column, r: str) -> Column:
        lo, hi = ends[f"lo_{r}"] or 0.0, ends[f"hi_{r}"] or 0.0
        return F.floor((value - F.lit(lo)) / F.lit(hi - lo) * steps).cast("long") if hi > lo else F.lit(0).cast("long")

    meta = meta.select("id", "size", "crc", "th", "ih", *[scaled(F.col(r), r).alias(r) for r in raw])
    tree = build_tree(meta, raw, shards, slack)
    names = [c for c in docs.columns if keep is None or c in keep]
    row = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.lit(None)
    placed = docs.select(
        row.alias("_row"), F.col(doc_id).alias("id"), (F.octet_length(filled) + overhead).cast("long").alias("size"), F.crc32(utf8(F.col(text))).alias("crc"),
        F.shiftrightunsigned(F.xxhash64(filled), 64 - TEXT_BITS).alias("th"), F.shiftrightunsigned(F.xxhash64(F.col(doc_id), F.lit(1)), 64 - ID_BITS).alias("ih"),
        *[F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0)).alias(r) for r, c in zip(raw, given.values())])
    placed = placed.withColumns({r: scaled(F.col(r), r) for r in raw}).withColumn("shard", _leaf(tree).cast("int"))
    numbered = number_series(placed.select("_row", "id", "size", "crc", "shard"), "shard", ["id", "crc"], step="slot")
    return unpack(numbered, names, size=F.col("size"), text_crc32=F.col("crc"), shard=F.col("shard"), slot=F.col("slot"))
