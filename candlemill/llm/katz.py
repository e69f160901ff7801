"""Katz backoff language model of word pairs, fitted and applied at corpus scale.

Two passes over the texts. The first counts words (each block of texts sends its distinct words once) and stores the unigram table.
The second sends every word, with the word before it and its place in a block, to the table of its word; there pair
counts are complete, Good-Turing discounts are taken, and each context's share of discounted and of backed-off mass is summed.
The sums meet by context, where the backoff weight is normalised exactly:

    P(w | h) = d(c) c(h, w) / c(h)  if c(h, w) > 0,  else  weight(h) P(w)
    weight(h) = (1 - sum over seen w of d c(h, w) / c(h)) / (1 - sum over seen w of P(w))

P(w) is the discounted unigram; its free mass is the probability of one unknown word. Only sums per (document, table)
and pairs that back off travel on. Tables are chosen by the hash of the word. A word that holds over 1/``HOT`` of all tokens is
spread over the tables by its contexts, and a context that frequent over ``SALT`` places. Good-Turing statistics of pairs
are summed over all tables before any discount is taken (``pooled``), or taken per table.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from candlemill.llm.columns import id_remainder
from candlemill.llm.text_arrays import mix, sorted_groups, text_pieces, word_hashes
from candlemill.sources.series import written

CUTOFF = 5  # counts above it are nearly undiscounted
REST = 0.1  # what a larger count leaves to the words not seen, so that every context can back off
HOT = 1000
SALT = 16
BLOCK_TOKENS = 2_000_000
TABLE_TOKENS = 1 << 21
END = np.uint64(0x0E5D0E5D0E5D0E5D)
BOS = np.uint64(0x0B050B050B050B05)


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing discount by count 0..CUTOFF from ``n[r]``, the number of types with count r (n has CUTOFF + 2 entries).

    Katz's form, which frees the mass n1/N in all. Where it gives nothing between 0 and 1, half an occurrence is taken off.
    """
    d = np.array([0.0] + [1 - 0.5 / r for r in range(1, CUTOFF + 1)])
    if n[1] > 0:
        over = (CUTOFF + 1) * n[CUTOFF + 1] / n[1]
        for r in range(1, CUTOFF + 1):
            if n[r] > 0 and over < 1:
                value = ((r + 1) * n[r + 1] / (r * n[r]) - over) / (1 - over)
                if 0 < value < 1:
                    d[r] = value
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Counts less their discount."""
    return np.where(c <= CUTOFF, d[np.minimum(c, CUTOFF)] * c, c - REST)


def _slim(a: np.ndarray) -> np.ndarray:
    """The same unsigned numbers in the narrowest type."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _pack(**arrays: np.ndarray) -> bytes:
    head = json.dumps([[k, a.dtype.str, len(a)] for k, a in arrays.items()]).encode()
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays.values()))


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    size, out = int.from_bytes(raw[:4], "little"), {}
    at = 4 + size
    for name, kind, n in json.loads(raw[4 : 4 + size]):
        out[name] = np.frombuffer(raw, kind, n, at)
        at += out[name].nbytes
    return out


def _sorted_words(a: np.ndarray) -> np.ndarray:
    """Differences of sorted 64-bit words."""
    return np.diff(a, prepend=np.uint64(0))


_ROWS = pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("block", pa.int64()), ("blob", pa.binary())])
_DDL = "part long, kind int, block long, blob binary"


def _row(part: int, kind: int, block: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([kind], pa.int32()), pa.array([block]), pa.array([blob], pa.binary())], schema=_ROWS)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, learns, words, first word of each text) of pieces of (id, learns, text) batches."""
    for batch in batches:
        learns = np.asarray(batch.column(1))
        for row, data, offsets in text_pieces(batch.column(2)):
            words, at = word_hashes(data, offsets)
            n = len(offsets) - 1
            yield batch.column(0).slice(row, n), learns[row : row + n], words, at


def _with_ends(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with END behind each text, and where each text begins."""
    n = len(at) - 1
    out = np.full(len(words) + n, END, np.uint64)
    starts = at + np.arange(n + 1)
    stay = np.ones(len(out), bool)
    stay[starts[1:] - 1] = False
    out[stay] = words
    return out, starts


def unigram_table(docs: DataFrame, parts: int) -> DataFrame:
    """``word`` (hash), ``c`` over the rows of ``docs`` (id, learns, text) that learn, stored in the shared folder."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            words, n = np.unique(np.concatenate(held), return_counts=True)
            place = (mix(words) % np.uint64(parts)).astype(np.int64)
            for p in np.unique(place).tolist():
                own = place == p
                yield _row(p, 0, 0, _pack(w=_sorted_words(words[own]), n=_slim(n[own])))

        for _, learns, words, at in _texts(batches):
            tokens, starts = _with_ends(words, at)
            held.append(tokens[np.repeat(learns, np.diff(starts))])
            size += len(held[-1])
            if size >= BLOCK_TOKENS:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["part"]):
            blobs = [_unpack(b) for b in group["blob"].to_pylist()]
            words, inverse = np.unique(np.concatenate([np.cumsum(b["w"], dtype=np.uint64) for b in blobs]), return_inverse=True)
            n = np.bincount(inverse, weights=np.concatenate([b["n"] for b in blobs])).astype(np.int64)
            for a in range(0, len(words), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(words[a : a + (1 << 18)].view(np.int64)), pa.array(n[a : a + (1 << 18)])], names=["word", "c"])

    sent = docs.mapInArrow(count, _DDL).repartition("part").sortWithinPartitions("part")
    return written(sent.mapInArrow(add, "word long, c long"), "katz-unigrams")


class Unigrams:
    """Totals of the unigram table: enough for every P(w), given c(w)."""

    def __init__(self, table: DataFrame):
        r = table.agg(F.sum("c"), F.count(F.lit(1)), F.sum(F.when(F.col("c") > CUTOFF, F.col("c") - REST)), *[F.count_if(F.col("c") == k) for k in range(1, CUTOFF + 2)]).head()
        self.n, self.v = int(r[0] or 0), int(r[1])
        self.d = discounts([0, *[int(x) for x in r[3:]]])
        seen = float(r[2] or 0.0) + sum(self.d[k] * k * int(r[2 + k]) for k in range(1, CUTOFF + 1))
        self.unknown = 1 - seen / self.n if self.n else 1.0
        hot = table.filter(F.col("c") > max(self.n / HOT, 1000)).collect()  # fewer than HOT words
        self.hot = dict(sorted((int(x["word"]) & (2**64 - 1), int(x["c"])) for x in hot))
        ends = table.filter(F.col("word") == int(END.astype(np.int64))).head()
        self.documents = int(ends["c"]) if ends else 0

    def log10(self, c: np.ndarray) -> np.ndarray:
        share = discounted(np.maximum(c, 1), self.d) / max(self.n, 1)
        return np.log10(np.where(c > 0, share, self.unknown))


def _send(uni: Unigrams, tables: int):
    """Words with their contexts, block by block, to the tables of the words."""
    hot = np.array(list(uni.hot), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        names, flags, held, size = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            block = task << 24 | number
            ids = pa.concat_arrays(names)
            learns = np.concatenate(flags)
            words = np.concatenate([w for w, _ in held])
            lengths = np.concatenate([np.diff(s) for _, s in held])
            starts = np.concatenate(([0], np.cumsum(lengths)))
            doc = np.repeat(np.arange(len(lengths)), lengths)
            before = np.empty_like(words)
            before[1:] = words[:-1]
            before[starts[:-1]] = BOS
            key = mix(words)
            if len(hot):
                is_hot = np.isin(words, hot)
                key[is_hot] = mix(key[is_hot] ^ mix(before[is_hot]))
            place = (key % np.uint64(tables)).astype(np.int64)
            order = np.lexsort((doc, before, words, place))
            words, before, doc, place = words[order], before[order], doc[order], place[order]
            cuts = np.searchsorted(place, np.arange(tables + 1))
            bits = np.packbits(learns)
            for p in range(tables):
                a, b = int(cuts[p]), int(cuts[p + 1])
                if a == b:
                    continue
                w, n = np.unique(words[a:b], return_counts=True)
                h, at = np.unique(before[a:b], return_inverse=True)
                yield _row(p, 0, block, _pack(w=_sorted_words(w), n=_slim(n), h=_sorted_words(h), at=_slim(at), doc=_slim(doc[a:b]), learns=bits, docs=np.array([len(learns)], np.uint32)))
            yield _row(block % tables, 1, block, _pack(ids=np.asarray(ids.fill_null(0)), null=np.asarray(ids.is_null()), learns=learns))

        for ids, learns, words, at in _texts(batches):
            names.append(ids)
            flags.append(learns)
            held.append(_with_ends(words, at))
            size += len(held[-1][0])
            if size >= BLOCK_TOKENS:
                yield from flush()
                names, flags, held, size, number = [], [], [], 0, number + 1
        if names:
            yield from flush()

    return run


class Pairs:
    """Complete pair counts of one table, from the blocks' blobs."""

    def __init__(self, blobs: list[dict[str, np.ndarray]], uni: Unigrams, pooled: list[int] | None = None):
        self.sizes = [int(b["docs"][0]) for b in blobs]
        first = np.concatenate(([0], np.cumsum(self.sizes)))
        self.doc = np.concatenate([b["doc"].astype(np.int32) + np.int32(f) for b, f in zip(blobs, first)])
        self.first = first
        learns = np.concatenate([np.unpackbits(b["learns"], count=s).astype(bool) for b, s in zip(blobs, self.sizes)])
        words = np.concatenate([np.cumsum(b["w"], dtype=np.uint64) for b in blobs])
        self.words, at = np.unique(words, return_inverse=True)
        self.w = np.repeat(at.astype(np.int32), np.concatenate([b["n"] for b in blobs]))
        contexts = [np.cumsum(b["h"], dtype=np.uint64) for b in blobs]
        self.contexts, at = np.unique(np.concatenate(contexts), return_inverse=True)
        shift = np.concatenate(([0], np.cumsum([len(c) for c in contexts])))
        self.h = at.astype(np.int32)[np.concatenate([b["at"].astype(np.int32) + np.int32(s) for b, s in zip(blobs, shift)])]
        del contexts, words, at
        train = learns[self.doc]
        self.count = np.bincount(self.w[train], minlength=len(self.words))  # c(w)
        for i in np.flatnonzero(np.isin(self.words, np.array(list(uni.hot), np.uint64))) if uni.hot else ():
            self.count[i] = uni.hot[int(self.words[i])]
        key = self.w.astype(np.int64) * len(self.contexts) + self.h
        order = np.argsort(key, kind="stable").astype(np.int32)
        key = key[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        del key
        group = np.cumsum(new, dtype=np.int32) - np.int32(1)
        c = np.add.reduceat(train[order].astype(np.int32), np.flatnonzero(new))
        self.c = np.empty(len(group), np.int32)  # c(h, w) of every occurrence
        self.c[order] = c[group]
        del group
        self.pair_w, self.pair_h, self.pair_c = self.w[order][new], self.h[order][new], c
        self.n = np.bincount(np.minimum(c, CUTOFF + 2), minlength=CUTOFF + 3)[: CUTOFF + 2]  # of counts
        self.d = discounts(self.n.tolist() if pooled is None else pooled)


def _counts_of_counts(uni: Unigrams):
    """One row of each table: how many of its pairs have count 1 to CUTOFF + 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["part"]):
            blobs = [b for k, b in zip(group["kind"].to_pylist(), group["blob"].to_pylist()) if k == 0]
            if blobs:
                n = Pairs([_unpack(b) for b in blobs], uni).n
                yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in n[1:]], names=[f"n{r}" for r in range(1, CUTOFF + 2)])

    return run


def _tables(uni: Unigrams, kinds: str, parts: int):
    """Of each table: sums per block and document (kind 0), or (``kinds`` "contexts") mass per context (2) and pairs
    that back off (3)."""
    hot = np.array(list(uni.hot) + [int(BOS)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["part"]):
            kind, blocks, blobs = group["kind"].to_numpy(), group["block"].to_numpy(), group["blob"].to_pylist()
            if kinds == "documents":
                for i in np.flatnonzero(kind == 1).tolist():
                    yield _row(int(blocks[i]), 1, int(blocks[i]), blobs[i])
            mine = np.flatnonzero(kind == 0)
            if not len(mine):
                continue
            pooled = [0, *group["n"][0].as_py()] if "n" in group.column_names else None
            t = Pairs([_unpack(blobs[i]) for i in mine.tolist()], uni, pooled)
            own = blocks[mine]
            del group, blobs
            if kinds == "documents":
                value = np.log10(np.maximum(discounted(t.c, t.d), 1e-300))
                value[t.c == 0] = uni.log10(t.count)[t.w[t.c == 0]]
                is_end = t.words == END
                as_context = np.where((t.count > 0) & ~is_end, np.log10(np.maximum(t.count, 1)), 0.0)
                value -= as_context[t.w]
                total = int(t.first[-1])
                score = np.bincount(t.doc, weights=value, minlength=total)
                del value
                base = np.bincount(t.doc, weights=np.log10(t.count + 0.5)[t.w], minlength=total)
                n, known = np.bincount(t.doc, minlength=total), np.bincount(t.doc, weights=(t.count > 0)[t.w], minlength=total).astype(np.int64)
                for b, x, y in zip(own.tolist(), t.first[:-1].tolist(), t.first[1:].tolist()):
                    yield _row(b, 0, b, _pack(score=score[x:y], base=base[x:y], n=_slim(n[x:y]), known=_slim(known[x:y])))
                continue
            seen = t.pair_c > 0
            h, pc = t.pair_h[seen], t.pair_c[seen]
            size = len(t.contexts)
            mass = np.bincount(h, weights=discounted(pc, t.d), minlength=size)
            total = np.bincount(h, weights=pc, minlength=size).astype(np.int64)
            lower = np.bincount(h, weights=10.0 ** uni.log10(t.count)[t.pair_w[seen]], minlength=size)
            is_hot = np.isin(t.contexts, hot)
            spread = mix(t.contexts ^ np.uint64(0xC0117E87))
            there = total > 0
            for salt in range(SALT if is_hot.any() else 1):
                pick = there & (is_hot if salt else True)
                name = mix(spread + np.uint64(salt))  # of the context and its place
                order = np.argsort(name)
                place = (name % np.uint64(parts)).astype(np.int64)
                for p in np.unique(place[pick]).tolist():
                    o = order[(pick & (place == p))[order]]
                    yield _row(p, 2, 0, _pack(h=_sorted_words(name[o]), mass=mass[o], total=_slim(total[o]), lower=lower[o]))
            out = np.flatnonzero(t.c == 0)
            block = np.searchsorted(t.first, t.doc[out], "right") - 1
            inside = t.doc[out] - t.first[block]
            salts = np.where(is_hot[t.h[out]], inside % SALT, 0).astype(np.uint64)
            name = mix(spread[t.h[out]] + salts)
            place = (name % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((inside, block, name, place))
            name, block, inside, place = name[order], block[order], inside[order], place[order]
            cuts = np.searchsorted(place, np.arange(parts + 1))
            for p in range(parts):
                a, b = int(cuts[p]), int(cuts[p + 1])
                if a < b:
                    h, n = np.unique(name[a:b], return_counts=True)
                    yield _row(p, 3, 0, _pack(h=_sorted_words(h), n=_slim(n), block=_slim(block[a:b]), doc=_slim(inside[a:b]), blocks=own))

    return run


def backoff_weight(mass: np.ndarray, total: np.ndarray, lower: np.ndarray) -> np.ndarray:
    return (1 - mass / total) / np.maximum(1 - lower, 1e-12)


def _back_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """log10 of weight and context count, summed per document, of the pairs that back off."""
    for group in sorted_groups(batches, ["part"]):
        kind, blobs = group["kind"].to_numpy(), group["blob"].to_pylist()
        sums = [_unpack(blobs[i]) for i in np.flatnonzero(kind == 2)]
        pairs = [_unpack(blobs[i]) for i in np.flatnonzero(kind == 3)]
        if not sums or not pairs:
            continue
        h, at = np.unique(np.concatenate([np.cumsum(s["h"], dtype=np.uint64) for s in sums]), return_inverse=True)
        add = lambda k: np.bincount(at, weights=np.concatenate([s[k] for s in sums]), minlength=len(h))
        mass, total, lower = add("mass"), add("total"), add("lower")
        value = np.log10(backoff_weight(mass, total, lower)) + np.log10(total)
        words = np.repeat(np.concatenate([np.cumsum(p["h"], dtype=np.uint64) for p in pairs]), np.concatenate([p["n"] for p in pairs]))
        where = np.minimum(np.searchsorted(h, words), len(h) - 1)
        gain = np.where(h[where] == words, value[where], 0.0)
        block = np.concatenate([p["blocks"][p["block"].astype(np.int64)] for p in pairs])
        doc = np.concatenate([p["doc"].astype(np.int64) for p in pairs])
        order = np.lexsort((doc, block))
        block, doc, gain = block[order], doc[order], gain[order]
        new = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (doc[1:] != doc[:-1]))))
        gain, block, doc = np.add.reduceat(gain, new), block[new], doc[new]
        edge = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(block)]):
            yield _row(int(block[a]), 4, int(block[a]), _pack(doc=_slim(doc[a:b]), gain=gain[a:b]))


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _gather(uni: Unigrams):
    start = -math.log10(uni.documents) if uni.documents else 0.0
    scale = math.log10(uni.n + 0.5 * (uni.v + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["part"]):
            kind, blobs = group["kind"].to_numpy(), group["blob"].to_pylist()
            meta = _unpack(blobs[int(np.flatnonzero(kind == 1)[0])])
            n = len(meta["ids"])
            score, base, tokens, known = np.full(n, start), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            parts = [_unpack(blobs[i]) for i in np.flatnonzero(kind == 0)]
            # one order of adding, whatever order the tables arrive in
            for p in sorted(parts, key=lambda p: (int(p["n"].sum()), p["score"].tobytes())):
                score, base, tokens, known = score + p["score"], base + p["base"], tokens + p["n"], known + p["known"]
            for p in sorted((_unpack(blobs[i]) for i in np.flatnonzero(kind == 4)), key=lambda p: (len(p["gain"]), p["gain"].tobytes())):
                score[p["doc"]] += p["gain"]
            ids = pa.array(meta["ids"].astype(np.int64), mask=meta["null"].astype(bool))
            yield pa.RecordBatch.from_arrays([ids, pa.array(~meta["learns"].astype(bool)), pa.array(tokens), pa.array(known), pa.array(base - tokens * scale), pa.array(score)],
                                             names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def katz_scores(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", divisor: int = 5, held_out: int = 1, tables: int | None = None, pooled: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Words are lower-cased in A-Z; every text ends with one end token, so null and empty texts have one token. Rows whose
    crc32(id as text) mod ``divisor`` is not ``held_out`` are learnt from; a null id counts as the empty text. Repeated
    rows are learnt from and scored one by one. ``score`` is log10 of the text's probability. With nothing to learn from,
    every token is the unknown word with probability 1. ``tables`` defaults to one for each ``TABLE_TOKENS`` tokens
    learnt from (16 at least). With ``pooled`` the pairs' Good-Turing statistics are those of all tables, and scores do not
    depend on ``tables``; else they are taken per table, which saves one reading of the tables.
    Words are 64-bit hashes.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), (id_remainder(F.col(doc_id), divisor) != held_out).alias("learns"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    uni = Unigrams(unigram_table(rows, 64))
    tables = tables or max(16, 1 << math.ceil(math.log2(max(1, uni.n / TABLE_TOKENS))))
    sent = rows.mapInArrow(_send(uni, tables), _DDL).repartition(tables, "part")
    if pooled:  # one row, met by every table; the exchange below it is the same one
        names = [f"n{r}" for r in range(1, CUTOFF + 2)]
        n = sent.sortWithinPartitions("part", "block").mapInArrow(_counts_of_counts(uni), ", ".join(f"{x} long" for x in names)).agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in names])
        sent = sent.crossJoin(F.broadcast(n.select(F.array(*names).alias("n"))))
    sent = sent.sortWithinPartitions("part", "block")  # behind the join, which would drop an order below it
    sums = sent.mapInArrow(_tables(uni, "documents", tables), _DDL)
    contexts = sent.mapInArrow(_tables(uni, "contexts", tables), _DDL).repartition(tables, "part").sortWithinPartitions("part")
    parts = sums.unionByName(contexts.mapInArrow(_back_off, _DDL)).repartition("part").sortWithinPartitions("part")
    return parts.mapInArrow(_gather(uni), _OUT).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(uni.n).cast("long").alias("train_tokens"), "base_score", "score")
