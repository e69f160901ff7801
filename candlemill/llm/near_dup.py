"""Near-duplicates: MinHash bands propose, odd sketches screen, full shingle sets decide.

One pass over the texts gives each document a fingerprint of its shingle set, ``BANDS`` hashes of ``ROWS`` MinHash samples
each, and an odd sketch: every sample toggles one of ``BITS`` bits. Two sketches differ in at most two bits for each
sample in which the documents differ, so a popcount of the XOR above ``screen()`` proves (up to 1e-9) that a pair is
below the threshold. Documents with equal sets are one node from then on.

Nodes that share a band bucket and pass the screen are joined into clusters; every pair that can be a link lies within a
cluster. The shingle sets of clustered nodes alone are read again. A cluster is cut into blocks of about ``BLOCK`` nodes
that share a few pivots; inside a task a pair is verified on its full sets unless both are already in one component.
Only nodes outside their cluster's main component then meet the cluster's other blocks. What leaves a task is a
spanning forest, never the pairs of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from candlemill.llm.columns import pack, unpack
from candlemill.llm.components import components
from candlemill.llm.text_arrays import mix, release, shingle_sets, sorted_groups, text_pieces, word_hashes
from candlemill.sources.series import written

ROWS = 4
MISS = 1e-7
BITS = 512
BLOCK = 128
PIVOTS = 16
SMALL_BUCKET = 256
BROADCAST_ROWS = 1_000_000  # 24 bytes each: a side of up to 24 MB is broadcast


def bands_for(threshold: float) -> int:
    """Bands so that a pair at the threshold shares none with a chance of at most ``MISS``."""
    return math.ceil(math.log(MISS) / math.log1p(-(threshold**ROWS)))


def screen(threshold: float, samples: int, miss: float = 1e-9) -> int:
    """Most XOR bits of a pair at the threshold: twice the binomial quantile of differing samples."""
    p, tail, d = 1 - threshold, 1.0, 0
    prob = (1 - p) ** samples
    while True:
        tail -= prob
        if tail < miss or d == samples:
            return 2 * d
        prob *= (samples - d) / (d + 1) * p / (1 - p)
        d += 1


def _odd(samples: int) -> np.ndarray:
    return np.random.default_rng(11).integers(1, 2**63, (2, samples), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sign_sets(sets: list[np.ndarray], bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (texts x bands) and odd sketches (texts x BITS/8 bytes) of non-empty sets."""
    samples = bands * ROWS
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    turn, odd = _odd(samples)
    least = np.empty((len(sets), samples), np.uint64)
    for piece in range(0, len(sets), 256):  # keeps the flat piece in cache
        a = starts[piece]
        b = starts[piece + 256] if piece + 256 < len(sets) else len(flat)
        own = flat[a:b]
        for j in range(samples):
            least[piece : piece + 256, j] = np.minimum.reduceat((own ^ turn[j]) * odd[j], starts[piece : piece + 256] - a)
    least = mix(least + np.arange(samples, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    sums = least.reshape(len(sets), bands, ROWS)
    hashes = mix(sums[:, :, 0] * odd[0] + sums[:, :, 1] * odd[1] + sums[:, :, 2] * odd[2] + sums[:, :, 3] * odd[3])
    bit = (least >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64) + np.arange(len(sets))[:, None] * BITS
    parity = (np.bincount(bit.ravel(), minlength=len(sets) * BITS) & 1).astype(np.uint8).reshape(len(sets), BITS)
    return hashes, np.packbits(parity, axis=1)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set that are independent of its order."""
    if not len(s):
        return 0, 0
    a = int(np.bitwise_xor.reduce(mix(s + np.uint64(1)))) ^ len(s) * 0x9E3779B97F4A7C15
    b = int(np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D))))
    return a & (2**64 - 1), b & (2**64 - 1)


def _signed(values) -> np.ndarray:
    return np.asarray(values, np.uint64).view(np.int64)


_SIGNATURE = pa.schema([
    ("doc_id", pa.int64()), ("th", pa.int64()), ("node", pa.int64()), ("proof", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])


def _sets_of(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for row, data, offsets in text_pieces(batch.column(batch.schema.get_field_index("text"))):
        yield row, shingle_sets(*word_hashes(data, offsets), width)
    release()


def signatures(docs: DataFrame, threshold: float, width: int) -> DataFrame:
    """One row per document (``doc_id``, ``th``, ``text`` in): node, set size, band hashes and sketch (null when empty)."""
    bands = bands_for(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in _sets_of(batch, width):
                full = [i for i, s in enumerate(sets) if len(s)]
                hashes = np.zeros((0, bands), np.uint64)
                if full:
                    hashes, sketches = sign_sets([sets[i] for i in full], bands)
                marks = [fingerprint(s) for s in sets]
                at = np.full(len(sets), -1)
                at[full] = np.arange(len(full))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum(np.where(at >= 0, bands, 0)))).astype(np.int32)), pa.array(_signed(hashes.ravel())))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, len(sets)), batch.column(1).slice(row, len(sets)), pa.array(_signed([m[0] for m in marks])), pa.array(_signed([m[1] for m in marks])),
                    pa.array([len(s) for s in sets], pa.int64()), lists, pa.array([sketches[i].tobytes() if i >= 0 else None for i in at], pa.binary())], schema=_SIGNATURE)

    return docs.mapInArrow(run, "doc_id long, th long, node long, proof long, n long, bands array<long>, sketch binary")


class Forest:
    """Union-find over the rows of one task's group."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def _differing(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """XOR popcounts of all rows of two sketch tables."""
    out = np.zeros((len(left), len(right)), np.int32)
    for k in range(left.shape[1]):
        out += np.bitwise_count(left[:, k, None] ^ right[None, :, k])
    return out


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), BITS // 64)


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(pairs: list[tuple[int, int]], nodes: np.ndarray) -> pa.RecordBatch:
    at = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(nodes[at[:, 0]]), pa.array(nodes[at[:, 1]])], schema=_EDGE)


def _bucket_forests(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["bucket"]):
            if len(group) < 2:
                continue
            nodes, sketch, forest, pairs = group["node"].to_numpy(), _sketches(group["sketch"]), Forest(len(group)), []
            near = np.argwhere(np.triu(_differing(sketch, sketch) <= most, 1))
            for a, b in near.tolist():
                if forest.join(a, b):
                    pairs.append((a, b))
            if pairs:
                yield _edges(pairs, nodes)

    return run


def _verified(threshold: tuple[int, int], most: int, key: list[str]):
    """Forests of verified links: all pairs of a block, or (``side`` 1 against 0) the probes against a block."""
    over, under = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, key):
            n = len(group)
            nodes, comp, side = group["node"].to_numpy(), group["comp"].to_numpy(), group["side"].to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in group["shingles"].to_pylist()]
            sizes = np.array([len(s) for s in sets])
            sketch = _sketches(group["sketch"])
            differ = _differing(sketch, sketch)
            low, high = np.minimum(sizes[:, None], sizes), np.maximum(sizes[:, None], sizes)
            open_pairs = (differ <= most) & (under * low >= over * high) & (comp[:, None] != comp)
            if side.any():
                open_pairs &= side[:, None] != side
            a, b = np.nonzero(np.triu(open_pairs, 1))
            forest, pairs, first = Forest(n), [], {}
            for i, c in enumerate(comp.tolist()):  # what is one component already needs no link
                forest.join(first.setdefault(c, i), i)
            for k in np.argsort(differ[a, b], kind="stable").tolist():
                i, j = int(a[k]), int(b[k])
                if forest.find(i) == forest.find(j):
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if under * both >= over * (len(sets[i]) + len(sets[j]) - both):
                    forest.join(i, j)
                    pairs.append((i, j))
            if pairs:
                yield _edges(pairs, nodes)
        release()

    return run


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = 80, width: int = 5,
) -> DataFrame:
    """One row per document: ``doc_id``, ``th`` (hash of the text), ``node``, ``root``, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked when 100 * intersection >= ``percent`` * union of their sets of distinct ``width``-word
    shingles (words lower-cased in A-Z; a shorter text is one shingle). ``component_id`` is the smallest id that can be
    reached. Null and wordless texts have no shingles and stand alone, each under its own id. Repeated rows are one
    node; ``kept`` marks every row whose id is its component's. Ids that are null are never the smallest unless all are.
    ``root`` tells components apart where ids do not (null or shared ids); it is null for wordless texts.
    Set elements and nodes are 64-bit hashes; two sets with one node hash are told apart by a second hash and raise.
    """
    threshold = percent / 100
    bands = bands_for(threshold)
    most = screen(threshold, bands * ROWS)
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    signed = written(signatures(base, threshold, width), "near-signatures")
    nodes = written(
        signed.filter("n > 0").groupBy("node").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("row"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.min("proof").alias("p0"), F.max("proof").alias("p1")),
        "near-nodes")
    if nodes.filter("p0 != p1").head(1):
        raise ValueError("two shingle sets share a 64-bit fingerprint")
    spread = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("least")).filter("members > 1")
    met = written(spread.join(shared, "bucket"), "near-buckets")
    stars = met.filter(F.col("members") > SMALL_BUCKET).select(F.col("node").alias("a"), F.col("least").alias("b"))
    small = met.filter(F.col("members") <= SMALL_BUCKET).select("bucket", "node").join(nodes.select("node", "sketch"), "node")
    small = small.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "node", "sketch")
    clusters = written(components(small.mapInArrow(_bucket_forests(most), "a long, b long").unionByName(stars)), "near-clusters")
    sizes = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    # the texts of clustered nodes once more, for their full sets
    wanted = clusters.join(nodes.select("node", "row.doc_id", "row.th"), "node").select("node", "doc_id", "th")
    if clusters.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    again = base.join(wanted, base["doc_id"].eqNullSafe(wanted["doc_id"]) & (base["th"] == wanted["th"])).select("node", "text")

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in _sets_of(batch, width):
                own = batch.column(0).slice(row, len(sets)).to_numpy()
                is_it = np.flatnonzero(_signed([fingerprint(s)[0] for s in sets]) == own)
                if len(is_it):
                    sketches = sign_sets([sets[i] for i in is_it], bands)[1]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(own[is_it]), pa.array([sets[i].tobytes() for i in is_it], pa.binary()), pa.array([s.tobytes() for s in sketches], pa.binary())],
                        names=["node", "shingles", "sketch"])

    full = again.mapInArrow(full_sets, "node long, shingles binary, sketch binary").groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("sketch").alias("sketch"))
    full = written(full.join(clusters, "node").join(sizes, "root"), "near-sets")
    draw = F.xxhash64("node", F.lit(5))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own_block = F.pmod(draw, blocks).cast("int")
    is_pivot = (blocks > 1) & (F.pmod(F.xxhash64("node", F.lit(6)), F.col("m")) < PIVOTS)
    placed = full.withColumn("block", F.explode(F.when(is_pivot, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own_block))))
    shape = ["root", "block", "node", "comp", "side", "shingles", "sketch"]
    placed = placed.withColumns({"comp": F.col("node"), "side": F.lit(0)}).repartition("root", "block").sortWithinPartitions("root", "block").select(*shape)
    bounds = (percent, 100)
    links = written(placed.mapInArrow(_verified(bounds, most, ["root", "block"]), "a long, b long"), "near-links")
    large = full.filter(F.col("m") > BLOCK)
    if large.head(1):
        sub = written(components(links).withColumnRenamed("root", "comp"), "near-parts")
        large = large.join(sub, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        main = large.groupBy("root", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("root").agg(F.max(F.struct("c", "comp")).alias("main"), F.sum("c").alias("all"))
        main = main.select("root", F.col("main.comp").alias("main"), F.ceil((F.col("all") - F.col("main.c")) / BLOCK).cast("int").alias("probes")).filter("probes > 0")
        large = large.join(main, "root")
        every = F.ceil(F.col("m") / BLOCK).cast("int")
        probe = large.filter("comp != main").select("root", "node", "comp", "shingles", "sketch", F.pmod(draw, F.col("probes")).cast("int").alias("p"), F.explode(F.sequence(F.lit(0), every - 1)).alias("block"), F.lit(1).alias("side"))
        against = large.select("root", "node", "comp", "shingles", "sketch", F.explode(F.sequence(F.lit(0), F.col("probes") - 1)).alias("p"), F.pmod(draw, every).cast("int").alias("block"), F.lit(0).alias("side"))
        keys = ["root", "p", "block"]
        crossed = probe.unionByName(against).repartition(*keys).sortWithinPartitions(*keys).select("root", "p", "block", "node", "comp", "side", "shingles", "sketch")
        more = crossed.mapInArrow(_verified(bounds, most, keys), "a long, b long")
        links = links.unionByName(more)
    found = components(links)
    grouped = nodes.select("node", "row.doc_id").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = grouped.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = grouped.join(least, "root").select("node", "root", "component_id")
    out = signed.select("doc_id", "th", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).alias("node"))
    out = out.join(named, "node", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "th", "node", "root", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = 80, width: int = 5) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: that with the smallest id, one of repeated rows.

    Of unequal texts of one group that share the smallest id (or have none), that with the smallest hash stays. Wordless
    texts all stay. Rows keep all their columns, whatever their names; an empty table stays empty.
    """
    th = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    told = near_duplicates(docs, doc_id=doc_id, text=text, percent=percent, width=width)
    told = written(told.select("doc_id", "th", "root", "kept"), "near-told")
    worded = told.filter("kept AND root IS NOT NULL")
    several = worded.groupBy("root").agg(F.count(F.lit(1)).alias("rows"), F.min("th").alias("least")).filter("rows > 1")
    several = written(worded.join(several, "root").groupBy("doc_id", "th", "least").agg(F.count(F.lit(1)).alias("rows")), "near-several")
    gone = told.filter("NOT kept").select("doc_id", "th").unionByName(several.filter("th != least").select("doc_id", "th")).distinct()
    twice = several.filter("th = least AND rows > 1").select("doc_id", "th")
    rows = pack(docs, id=F.col(doc_id), th=th)

    def same(other: str) -> Column:
        return F.col("d.id").cast("long").eqNullSafe(F.col(f"{other}.doc_id")) & (F.col("d.th") == F.col(f"{other}.th"))

    kept = rows.alias("d").join(gone.alias("g"), same("g"), "left_anti")
    if twice.head(1):
        once = kept.alias("d").join(twice.alias("t"), same("t"), "left_anti")
        again = kept.alias("d").join(twice.alias("t"), same("t"), "left_semi")
        kept = once.unionByName(again.dropDuplicates(["id", "th"]))
    return unpack(kept, docs.columns)
