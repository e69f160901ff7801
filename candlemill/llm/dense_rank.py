"""Ranked lexical search by dense blocked multiplication.

The terms of the items form a compact vocabulary. A task multiplies tiles of item weights with tiles of document impacts
in float64; every partial sum stays below 2**53, so each product is an exact integer, and tiles are added as 64-bit
integers. Of every tile only the ``k`` best documents of each item go on, ties by the smaller id.

Nothing but items is shipped to the tasks, in groups whose bytes are measured first. Documents never move: what is shuffled
is ``k`` rows per item and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from candlemill.llm.text_arrays import release, text_pieces
from candlemill.sources.series import written

GROUP_BYTES = 8 << 20  # mean item bytes of a group
MOST_BYTES = 32 << 20  # no group of several items is larger
CELLS = 1 << 22  # float64 cells of an impact or weight tile
EXACT = 1 << 53
IMPACT = 1_000_000  # no impact reaches it
SALTS = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms (letters, digits and every character beyond ASCII; A-Z lower-cased) and where each text's terms begin."""
    n = len(data)
    letter = _TERM[data]
    begin = letter.copy()
    begin[1:] &= ~letter[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    begin[edges] = letter[edges]
    starts = np.flatnonzero(begin)
    body = _LOWER[data[letter]]
    place = np.append(np.cumsum(letter)[starts] - 1, len(body)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(place), pa.py_buffer(body)])
    return words, np.searchsorted(starts, offsets)


def _counts(owner: np.ndarray, term: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, term) pairs in order and how often each occurs."""
    pair, n = np.unique(owner.astype(np.int64) * max(width, 1) + term, return_counts=True)
    return pair // max(width, 1), pair % max(width, 1), n


class Items:
    """One group of items: vocabulary and, per item, its terms with their counts."""

    def __init__(self, uids: list[int], texts: list[str]):
        words, at = [], [0]
        for _, data, offsets in text_pieces(pa.array(texts, pa.string())):
            got, begin = terms_of(data, offsets)
            words.append(got)
            at += (begin[1:] + at[-1]).tolist()
        coded = pa.chunked_array(words, pa.large_binary()).combine_chunks().dictionary_encode()
        self.uids = np.array(uids, np.int64)
        self.vocabulary = coded.dictionary
        owner = np.repeat(np.arange(len(uids)), np.diff(at))
        self.item, self.term, self.n = _counts(owner, coded.indices.to_numpy(zero_copy_only=False), len(self.vocabulary))


def _holdings(group, docs: DataFrame) -> DataFrame:
    """Per document with at least one term: ``doc_id``, ``n``, and the group's terms in it (``term``, ``tf``)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("term", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = group.value.vocabulary
        for batch in batches:
            for first, data, offsets in text_pieces(batch.column(1)):
                words, at = terms_of(data, offsets)
                n = np.diff(at)
                found = pc.index_in(words, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
                known = found >= 0
                row, term, tf = _counts(np.repeat(np.arange(len(n)), n)[known], found[known], len(vocabulary))
                some = np.flatnonzero(n > 0)
                cuts = pa.array(np.append(np.searchsorted(row, some), len(row)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(n)).take(pa.array(some)), pa.array(n[some]), *lists], schema=schema)
        release()

    return docs.mapInArrow(count, "doc_id long, n long, term array<int>, tf array<int>")


def _document_counts(held: DataFrame, width: int) -> DataFrame:
    """Documents holding each term: a count per task, then summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(width, np.int64)
        for batch in batches:
            n += np.bincount(batch.column(0).flatten().to_numpy(), minlength=width)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["term", "df"])

    return held.select("term").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def weight_tiles(items: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_items: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(terms, item x term weights) tiles: each item's weights in a tile add up to less than 2**53 / ``IMPACT``.

    A weight too large for that is split over several tiles.
    """
    cap = EXACT // IMPACT // 2
    tiles: list[tuple[np.ndarray, np.ndarray]] = []
    while len(items):
        part = np.minimum(weights, cap)
        columns, column = np.unique(terms, return_inverse=True)
        largest = np.zeros(len(columns), np.int64)
        np.maximum.at(largest, column, part)
        most = max(1, CELLS // n_items)
        start = 0
        while start < len(columns):
            total = np.cumsum(largest[start : start + most])
            stop = start + max(1, int(np.searchsorted(total, 2 * cap, "left")))
            inside = (column >= start) & (column < stop)
            tile = np.zeros((n_items, stop - start))
            tile[items[inside], column[inside] - start] = part[inside]
            tiles.append((columns[start:stop], tile))
            start = stop
        rest = weights > cap
        items, terms, weights = items[rest], terms[rest], weights[rest] - cap
    return tiles


def _best(item, doc, none, score, k):
    """The ``k`` best rows of each item: highest score first, ties by the smaller id, a null id last."""
    order = np.lexsort((doc, none, -score, item))
    item, doc, none, score = item[order], doc[order], none[order], score[order]
    keep = np.arange(len(item)) - np.searchsorted(item, item) < k
    return item[keep], doc[keep], none[keep], score[keep]


def _scored(group, held: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """Per task and item the ``k`` best documents: ``uid``, ``doc_id``, ``score``."""
    shipped = held.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, w = group.value, shipped.value
        value = g.n * w[g.term]
        step = max(1, CELLS // max(1, min(len(g.vocabulary), 1 << 13)))  # items of a block
        blocks = []
        for a in range(0, len(g.uids), step):
            inside = (g.item >= a) & (g.item < a + step) & (value > 0)
            size = min(step, len(g.uids) - a)
            blocks.append((a, size, weight_tiles(g.item[inside] - a, g.term[inside], value[inside], size)))
        empty = np.zeros(0, np.int64)
        best = (empty, empty, empty.astype(bool), empty)
        least = np.ones(len(g.uids), np.int64)  # a score below it cannot enter
        widest = max([len(t) for _, _, tiles in blocks for t, _ in tiles], default=1)
        rows = max(16, CELLS // max(widest, step))

        def pieces():
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    yield batch.slice(at, rows)

        for piece in pieces():
            n = piece.column(1).to_numpy()
            if 25 * int(n.max()) * n_docs < 1 << 63:
                m = 75 + (25 * n * n_docs) // n_terms
            else:
                m = np.array([75 + (25 * x * n_docs) // n_terms for x in n.tolist()], np.int64)
            term, tf = piece.column(2).flatten().to_numpy(), piece.column(3).flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(piece.num_rows), pc.list_value_length(piece.column(2)).to_numpy())
            impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[row])
            ids = piece.column(0)
            doc, none = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
            for a, size, tiles in blocks:
                total = np.zeros((piece.num_rows, size), np.int64)
                for terms, tile in tiles:
                    at = np.full(len(g.vocabulary), -1, np.int64)
                    at[terms] = np.arange(len(terms))
                    place = at[term]
                    inside = place >= 0
                    dense = np.zeros((piece.num_rows, len(terms)))
                    dense[row[inside], place[inside]] = impact[inside]
                    total += (dense @ tile.T).astype(np.int64)
                r, c = np.nonzero(total >= least[a : a + size])
                if len(r):
                    best = _best(*[np.concatenate(x) for x in zip(best, (c + a, doc[r], none[r], total[r, c]))], k)
                    full = np.flatnonzero(np.arange(len(best[0])) - np.searchsorted(best[0], best[0]) == k - 1)
                    least[best[0][full]] = best[3][full]
        item, doc, none, got = best
        yield pa.RecordBatch.from_arrays([pa.array(g.uids[item]), pa.array(doc, mask=none), pa.array(got)], names=["uid", "doc_id", "score"])
        release()

    return held.mapInArrow(score, "uid long, doc_id long, score long")


def rank_documents(
    docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 20,
) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id``, ``score``: the ``k`` documents of highest score above 0 for each item row.

    Every row of ``docs`` is a document, every row of ``items`` a query of its own; repeated ids stay apart. Ids of documents
    are integers; equal scores go by ascending id, a null id last. Null and empty texts have no terms: such items return
    nothing, such documents are found by none and do not count. Texts of any length are read whole. Other columns are not
    looked at. Empty tables give no rows.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    asked = written(asked.withColumn("uid", F.monotonically_increasing_id()), "rank-items")
    size = F.sum(F.octet_length("text")).alias("bytes")
    n_items, n_bytes = asked.agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).head()
    groups = max(1, -(-n_bytes // GROUP_BYTES))

    def group_of():
        return F.pmod(F.xxhash64("uid"), F.lit(groups))

    def largest() -> int:
        sizes = asked.groupBy(group_of().alias("g")).agg(size, F.count(F.lit(1)).alias("n")).filter("n > 1")
        return sizes.agg(F.max("bytes")).head()[0] or 0

    while groups > 1 and largest() > MOST_BYTES:
        groups *= 2
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    best = None
    for g in range(groups if n_items else 0):
        rows = asked.filter(group_of() == g).select("uid", "text").collect()  # at most MOST_BYTES, or one item
        if not rows:
            continue
        group = Items([r.uid for r in rows], [r.text for r in rows])
        if not len(group.vocabulary):
            continue
        shipped = spark.sparkContext.broadcast(group)
        held = written(_holdings(shipped, own), "rank-holdings")
        n_docs, n_terms = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).head()
        if not n_docs:
            continue
        df = np.zeros(len(group.vocabulary), np.int64)
        counted = _document_counts(held, len(df)).toArrow()  # one row per term of the group
        df[counted["term"].to_numpy()] = counted["df"].to_numpy()
        weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        one = _scored(shipped, held, weights, n_docs, n_terms, k)
        best = one if best is None else best.unionByName(one)
    if best is None:
        return asked.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).filter("false")
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    salted = best.withColumn("salt", F.spark_partition_id() % SALTS)
    first = Window.partitionBy("uid", "salt").orderBy(*order)
    some = salted.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).drop("salt", "rank")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("uid").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.join(asked.select("uid", "item_id"), "uid").select("item_id", "rank", "doc_id", "score")
