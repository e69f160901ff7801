"""Approximate nearest neighbours by shifted Hilbert curves.

Each of ``curves`` random orthonormal projections to ``dims`` dimensions, with its own random shift, orders all vectors along
a Hilbert curve. The orders are range-partitioned and numbered by Spark, cut into blocks of ``window`` neighbours, and a
query meets its own block and the two beside it on every curve. Each block keeps a query's best, the curves' lists are
merged, and scores are inner products of the original vectors in double precision, summed from the first component on.

With ``recall`` the window is doubled until enough of the true neighbours of a bounded set of queries (brute force, one pass
over the vectors) lie in the windows; a window as long as the table holds all.

Largest inner products become nearest neighbours by one more coordinate that lifts all vectors to one norm; queries
have 0 there. Equal vectors are one entry on the curves with their smallest ids, so copies cannot fill a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from candlemill.llm.text_arrays import sorted_groups
from candlemill.sources.series import number_series, written

CURVES, DIMS, BITS, WINDOW = 16, 8, 6, 1024
SAMPLE = 128  # queries by which recall is measured


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer points (rows), each coordinate below 2**bits: Gray-code descent from
    the highest bit, exchanging and inverting lower bits, after Skilling (2004)."""
    x = np.ascontiguousarray(cells.T.astype(np.int64))
    n = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(n):
            inverted = (x[i] & bit) != 0
            swap = np.where(inverted, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inverted, low, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, bit = np.zeros(x.shape[1], np.int64), 1 << (bits - 1)
    while bit > 1:
        flip ^= np.where(x[n - 1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _projections(size: int, curves: int, dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(curves x size x dims) orthonormal directions, (curves x dims) shifts."""
    draw = np.random.default_rng(seed)
    dims = min(dims, size)
    turns = np.stack([np.linalg.qr(draw.normal(size=(size, dims)))[0] for _ in range(curves)])
    return turns, draw.random((curves, dims))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, size)


def _lifted(x: np.ndarray, top: float, query: np.ndarray) -> np.ndarray:
    rest = np.sqrt(np.maximum(0.0, top - (x * x).sum(1)))
    return np.concatenate([x, np.where(query, 0.0, rest)[:, None]], axis=1)


def _true_neighbours(entries: DataFrame, size: int, k: int) -> list[tuple[int, int]]:
    """(query, neighbour) pairs of ``SAMPLE`` queries chosen by hash: their best ``k`` other vectors, by brute force."""
    asked = entries.filter("query").orderBy(F.xxhash64("rep", F.lit(3))).select("rep", "v").head(SAMPLE)
    if not asked:
        return []
    names, q = np.array([r["rep"] for r in asked]), np.array([r["v"] for r in asked], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps, score = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
        for batch in batches:
            own = np.asarray(batch.column(0))
            new = q @ _matrix(batch.column(1), size).T
            new[names[:, None] == own] = -np.inf
            score, reps = np.concatenate([score, new], axis=1), np.concatenate([reps, np.broadcast_to(own, new.shape)], axis=1)
            if score.shape[1] > k:
                best = np.argpartition(-score, k - 1, axis=1)[:, :k]
                score, reps = np.take_along_axis(score, best, 1), np.take_along_axis(reps, best, 1)
        at = np.repeat(names, score.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(reps.ravel()), pa.array(score.ravel())], names=["rep", "other", "score"])

    found = entries.select("rep", "v").mapInArrow(run, "rep long, other long, score double").filter(F.col("score") > float("-inf"))
    best = Window.partitionBy("rep").orderBy(F.desc("score"), "other")
    return [(r["rep"], r["other"]) for r in found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).select("rep", "other").collect()]


def _window_for(recall: float, ranked: DataFrame, pairs: list[tuple[int, int]], curves: int, window: int) -> int:
    """The least doubling of ``window`` with ``recall`` of ``pairs``, less two standard errors over the queries."""
    if not pairs:
        return window
    wanted = ranked.sparkSession.createDataFrame([(r,) for r in sorted({r for p in pairs for r in p})], "rep long")
    step = {(r["rep"], r["query"], r["curve"]): r["step"] for r in ranked.join(F.broadcast(wanted), "rep").select("rep", "query", "curve", "step").collect()}
    asks = np.array([[step[q, 1, c] for c in range(curves)] for q, _ in pairs])
    there = np.array([[step[o, 0, c] for c in range(curves)] for _, o in pairs])
    _, query = np.unique([q for q, _ in pairs], return_inverse=True)
    while True:
        met = (np.abs(asks // window - there // window) <= 1).any(axis=1)
        each = np.bincount(query, weights=met) / np.bincount(query)
        if each.mean() - 2 * each.std() / np.sqrt(len(each)) >= recall:
            return window
        window *= 2


def nearest(
    vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, curves: int = CURVES,
    dims: int = DIMS, bits: int = BITS, window: int = WINDOW, seed: int = 17, recall: float | None = None,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` for every id divisible by ``every``.

    Candidates are all vectors but those of the query's own id; ties go to the smaller id. Null ids, null or zero
    vectors, vectors with null or non-finite components, and vectors whose length is not the most frequent one (the
    larger of equally frequent) take no part. Repeated rows count once. A query has fewer than ``k`` rows only if
    there are fewer candidates on its windows. An empty table gives an empty result. ``recall`` raises ``window`` until it is
    met; a block of a window is held in one task.
    """
    spark = vectors.sparkSession
    ok = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    valid = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v")).filter("id IS NOT NULL").filter(F.coalesce(ok, F.lit(False)))
    lengths = valid.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).head(1)
    out = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], out)
    size = lengths[0]["size"]
    each = valid.filter(F.size("v") == size).distinct()
    whole = each.groupBy("v").agg(F.min("id").alias("rep"), F.max((F.pmod("id", F.lit(every)) == 0)).alias("query"))
    first = each.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("n") <= k + 1)
    first = first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = written(whole.join(first, "v").withColumn("rep", F.xxhash64("v")), "ann-entries")
    if entries.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").head(1):
        raise ValueError("two vectors share a 64-bit hash")
    top = entries.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).head()[0] or 0.0
    turns, shifts = _projections(size + 1, curves, dims, seed)
    dims = turns.shape[2]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros((curves, dims)), np.zeros((curves, dims))
        for batch in batches:
            x = _lifted(_matrix(batch.column(0), size), top, np.zeros(batch.num_rows, bool))
            p = np.einsum("ns,csd->ncd", x, turns, optimize=True)
            n, total, square = n + len(x), total + p.sum(0), square + (p * p).sum(0)
        at = pa.array(np.arange(curves * dims), pa.int32())
        yield pa.RecordBatch.from_arrays([at, pa.array(np.full(curves * dims, n)), pa.array(total.ravel()), pa.array(square.ravel())], names=["at", "n", "total", "square"])

    sums = entries.select("v").mapInArrow(moments, "at int, n long, total double, square double").groupBy("at").agg(F.sum("n"), F.sum("total"), F.sum("square")).orderBy("at").collect()
    n = np.array([max(r[1], 1) for r in sums], float)
    center = np.array([r[2] for r in sums]) / n
    spread = np.sqrt(np.maximum(np.array([r[3] for r in sums]) / n - center**2, 0))
    center, spread = center.reshape(curves, dims), np.where(spread > 1e-12, spread, 1.0).reshape(curves, dims)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, asks = _matrix(batch.column(1), size), np.asarray(batch.column(2))
            rows = np.concatenate([np.arange(len(x)), np.flatnonzero(asks)])
            query = np.arange(len(rows)) >= len(x)
            lifted = _lifted(x[rows], top, query)
            raw = x.astype("<f4" if pa.types.is_float32(batch.schema.field(1).type.value_type) else "<f8")
            blobs = pa.array([raw[i].tobytes() for i in range(len(x))], pa.binary()).take(pa.array(rows))
            reps, leasts = batch.column(0).take(pa.array(rows)), batch.column(3).take(pa.array(rows))
            for c in range(curves):
                p = (lifted @ turns[c] - center[c]) / spread[c]
                cells = np.clip(((p + 3) / 8 + shifts[c] / 4) * (1 << bits), 0, (1 << bits) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), c, np.int32)), pa.array(hilbert_keys(cells.astype(np.int64), bits)), reps, pa.array(query.astype(np.int32)), blobs, leasts],
                                                 names=["curve", "key", "rep", "query", "v", "least"])

    placed = entries.select("rep", "v", "query", F.element_at("ids", 1).alias("least")).mapInArrow(place, "curve int, key long, rep long, query int, v binary, least long")
    ranked = number_series(placed, "curve", ["key", "rep", "query"], step="step")
    if recall is not None:
        window = _window_for(recall, ranked, _true_neighbours(entries, size, k), curves, window)
    own = F.floor(F.col("step") / window).cast("long")
    blocks = ranked.withColumn("block", F.explode(F.when(F.col("query") == 1, F.array(own - 1, own, own + 1)).otherwise(F.array(own))))
    blocks = blocks.repartition("curve", "block").sortWithinPartitions("curve", "block").select("curve", "block", "query", "rep", "v", "least")
    width = 4 if "float" in entries.schema["v"].dataType.simpleString() else 8

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["curve", "block"]):
            asks = group["query"].to_numpy() == 1
            if not asks.any() or asks.all():
                continue
            x = np.frombuffer(b"".join(group["v"].to_pylist()), "<f4" if width == 4 else "<f8").reshape(-1, size).astype(np.float64)
            reps = group["rep"].to_numpy()
            q, v, theirs, least = x[asks], x[~asks], reps[~asks], group["least"].to_numpy()[~asks]
            most, step = min(k + 2, len(v)), max(1, (1 << 21) // len(v))
            longest = np.sqrt((v * v).sum(1).max())
            for a in range(0, len(q), step):
                own = q[a : a + step]
                rough = own @ v.T
                # the matrix product may add in any order: all within its rounding of the last place are taken
                slack = 8 * size * np.finfo(float).eps * longest * np.sqrt((own * own).sum(1))
                last = np.partition(rough, len(v) - most, axis=1)[:, len(v) - most] - slack
                row, col = np.nonzero(rough >= last[:, None])
                exact = np.concatenate([np.cumsum(own[row[i : i + (1 << 15)]] * v[col[i : i + (1 << 15)]], axis=1)[:, -1] for i in range(0, len(row), 1 << 15)])
                order = np.lexsort((least[col], -exact, row))
                first = np.searchsorted(row, np.arange(len(own)))  # rows come in order
                order = order[np.arange(len(row)) - first[row[order]] < most]
                yield pa.RecordBatch.from_arrays([
                    pa.array(reps[asks][a : a + step][row[order]]), pa.array(theirs[col[order]]), pa.array(exact[order])], names=["rep", "other", "score"])

    met = blocks.mapInArrow(rerank, "rep long, other long, score double").groupBy("rep", "other").agg(F.max("score").alias("score"))
    ids = entries.select(F.col("rep").alias("other"), "ids", F.element_at("ids", 1).alias("least"))
    best = Window.partitionBy("rep").orderBy(F.desc("score"), "least")
    met = met.join(ids, "other").withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 2)
    lists = met.select("rep", F.explode("ids").alias("id"), "score").groupBy("rep").agg(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id", "score")).alias("found"))
    lists = lists.select("rep", F.slice(F.array_sort("found"), 1, k + 1).alias("found"))
    asked = each.filter(F.pmod("id", F.lit(every)) == 0).select(F.col("id").alias("query_id"), F.xxhash64("v").alias("rep"))
    rows = asked.join(lists, "rep").select("query_id", F.posexplode(F.slice(F.filter("found", lambda f: f["id"] != F.col("query_id")), 1, k)).alias("at", "f"))
    return rows.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.id").alias("vec_id"), F.col("f.score").alias("score"))
