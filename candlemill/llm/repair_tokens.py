"""Token ids in grammar-compressed shards (Re-Pair), with random access.

Documents are range-partitioned by id and each partition is one shard of blocks. A block holds whole documents, about
``BLOCK`` ids, and its own grammar: in each round the frequent pairs of neighbouring symbols become nonterminals, all
at once, left to right without overlap and never across the end of a document. Stored are the rules, the length each
nonterminal expands to, the symbols, and where each document's symbols begin. So any range of ids is decoded from the
symbols that cover it. The container is Parquet, one row a block.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from candlemill.llm.text_arrays import _LOWER, release, text_pieces, word_spans

BLOCK = 1 << 19
ROUNDS = 6
LEAST = 6
CACHED = 1_500_000

# --- tokenizing ---------------------------------------------------------------------------------------------------

_MARKS = ".,;:!?|$%&#*"
_MARK_BYTES = np.isin(np.arange(256), np.frombuffer(_MARKS.encode(), np.uint8))
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
AT_ONCE = 16 << 20  # bytes of text whose words are learnt together


class WordEncoder:
    """Encodes whole texts through the tokenizers library, each distinct word once for a run of texts.

    For a tokenizer that drops white space and never merges across it, the ids of a text are those of its words. Plain
    Latin words are parted from the marks behind them, and their ids are remembered over all runs; the
    word is lower-cased only if the tokenizer itself tells no letter and no word of its vocabulary apart by case. That table is emptied
    when it reaches ``CACHED`` entries, which costs time, never results.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core a task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        self.first_free = size
        self.parts: dict[str, bytes] = {"": b""}
        self.ends = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        # a tokenizer that keeps case tells apart a letter, or a word of its vocabulary, from the same in lower case
        cased = [chr(c) for c in range(0x41, 0x100)] + [t.removesuffix("</w>") for t in self.tokenizer.get_vocab()]
        cased = [w for w in cased if w != w.lower() and _PLAIN.fullmatch(w)]
        same = all(np.array_equal(a, b) for a, b in zip(self._ids(cased), self._ids([w.lower() for w in cased])))
        self.fold = str.lower if same else str
        # added tokens are found in the text before it is lower-cased
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_parts(self, parts: list[str]) -> None:
        width = np.dtype(self.dtype).itemsize
        for a in range(0, len(parts), 1 << 14):
            groups = [parts[i : i + 256] for i in range(a, min(a + (1 << 14), len(parts)), 256)]
            for group, ids in zip(groups, self._ids([" ".join(g) for g in groups])):
                cuts = ((np.flatnonzero(self.ends[ids]) + 1) * width).tolist()
                if len(cuts) == len(group) and cuts[-1] == len(ids) * width:
                    raw, last = ids.tobytes(), 0
                    for w, cut in zip(group, cuts):
                        self.parts[w] = raw[last:cut]
                        last = cut
                else:
                    self.parts.update((w, p.tobytes()) for w, p in zip(group, self._ids(group)))

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of each of the distinct words."""
        if len(self.parts) > CACHED:
            self.parts = {"": b""}
        known = self.parts
        found = list(map(known.get, words))
        plain, other = [], []
        for i in [i for i, ids in enumerate(found) if ids is None]:
            if _PLAIN.fullmatch(words[i]):
                plain.append((i, self.fold(words[i])))
            else:
                other.append(i)
        self._learn_parts(list({w for _, w in plain}.difference(known)))
        for i, w in plain:
            found[i] = known[w]
        for i, p in zip(other, self._ids([words[i] for i in other])):
            found[i] = p.tobytes()
        return found

    def encode_all(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a run. Words are told apart by 64-bit hashes; only distinct ones become strings."""
        hashes, starts, ends, at, blobs, base, words = [], [], [], [np.zeros(1, np.int64)], [], 0, 0
        for _, data, offsets in text_pieces(column):
            if self.fold is str.lower:
                low = _LOWER[data]
                whole = low.tobytes()
                data = data if any(t in whole for t in self.added) else low
            h, w, a, b = word_spans(data, offsets, False, _MARK_BYTES)
            hashes.append(h)
            starts.append(a + base)
            ends.append(b + base)
            at.append(w[1:] + words)
            blobs.append(data)
            base, words = base + len(data), words + len(h)
        if not blobs:
            return []
        at = np.concatenate(at)
        where = pa.array(np.concatenate(hashes)).dictionary_encode().indices.to_numpy()  # numbered as first met
        upto = np.maximum.accumulate(where)
        first = np.flatnonzero(np.diff(upto, prepend=-1))
        raw = np.concatenate(blobs).tobytes()
        spans = zip(np.concatenate(starts)[first].tolist(), np.concatenate(ends)[first].tolist())
        ids = self._word_ids([raw[a:b].decode() for a, b in spans])
        width = np.dtype(self.dtype).itemsize
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // width
        begin = np.concatenate(([0], np.cumsum(sizes)))[:-1] if len(sizes) else sizes
        each = sizes[where]
        upto = np.concatenate(([0], np.cumsum(each)))
        flat = np.frombuffer(b"".join(ids), self.dtype)[np.repeat(begin[where] - upto[:-1], each) + np.arange(upto[-1])]
        cuts = upto[at].tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per Python worker: the word tables last over its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


# --- grammar ------------------------------------------------------------------------------------------------------


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    """Upper bits of a multiplicative hash."""
    if keys.dtype == np.uint32:
        return (keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def compress(ids: np.ndarray, starts: np.ndarray, first_free: int, rounds: int = ROUNDS, least: int = LEAST) -> dict:
    """Grammar of a block. ``starts``: where each document's ids begin. At most 2**16 symbols where the vocabulary allows."""
    room = (1 << 16) - first_free if first_free < 1 << 16 else 1 << 20
    # pairs of two-byte symbols are sorted as four-byte numbers
    kind, shift = (np.uint32, np.uint32(16)) if first_free + room <= 1 << 16 else (np.uint64, np.uint64(32))
    seq = ids.astype(kind)
    last = np.zeros(len(seq) + 1, bool)  # the symbol ends a document
    last[starts[1:] - 1] = True
    last = last[: len(seq)]
    left, right, bounds = [], [], [first_free]
    counts_docs = starts
    for _ in range(rounds):
        if len(seq) < 2 or room <= 0:
            break
        keys = (seq[:-1] << shift) | seq[1:]
        order = np.sort(keys[~last[:-1]])
        if not len(order):
            break
        cut = np.flatnonzero(np.concatenate(([True], order[1:] != order[:-1])))
        n = np.diff(np.concatenate((cut, [len(order)])))
        distinct = order[cut]
        good = n >= least
        distinct, n = distinct[good], n[good]
        if not len(distinct):
            break
        most = max(room // 2, min(room, 256))  # the ids that are free are shared among the rounds
        if len(distinct) > most:
            top = np.sort(np.argsort(-n, kind="stable")[:most])
            distinct, n = distinct[top], n[top]
        # a table of pairs by a multiplicative hash; of pairs that collide the more frequent one waits for no round
        # a table of few pairs is small enough to stay near the processor
        bits, narrow = (18, np.int16) if len(distinct) < 1 << 15 else (20, np.int32)
        slot = _slots(distinct, bits)
        rank = np.argsort(n, kind="stable")
        table = np.full(1 << bits, -1, narrow)
        table[slot[rank]] = rank
        kept = np.flatnonzero(table[slot] == np.arange(len(distinct)))
        new = np.full(len(distinct), -1, np.int64)
        new[kept] = np.arange(len(kept))
        found = table[_slots(keys, bits)]
        hit = (found >= 0) & (distinct[found] == keys) & ~last[:-1]
        # of overlapping pairs every second one, from the left
        at = np.flatnonzero(hit)
        if not len(at):
            break
        run = np.concatenate(([0], np.flatnonzero(np.diff(at) > 1) + 1))
        offset = np.arange(len(at)) - np.repeat(run, np.diff(np.concatenate((run, [len(at)]))))
        at = at[offset % 2 == 0]
        rule = new[found[at]]
        taken = np.bincount(rule, minlength=len(kept)) > 0
        used, rule = np.flatnonzero(taken), (np.cumsum(taken) - 1)[rule]
        pairs = distinct[kept[used]]
        base = bounds[-1]
        left.append((pairs >> shift).astype(np.int64))
        right.append((pairs & kind((1 << int(shift)) - 1)).astype(np.int64))
        seq[at] = (base + rule).astype(kind)
        last[at] |= last[at + 1]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq, last = seq[stay], last[stay]
        bounds.append(base + len(pairs))
        room -= len(pairs)
        if len(at) < len(seq) // 200:  # pairs that are still frequent shorten the block no more
            break
    left = np.concatenate(left) if left else np.zeros(0, np.int64)
    right = np.concatenate(right) if right else np.zeros(0, np.int64)
    lengths = np.ones(bounds[-1], np.int64)
    for a, b in zip(bounds, bounds[1:]):
        lengths[a:b] = lengths[left[a - first_free : b - first_free]] + lengths[right[a - first_free : b - first_free]]
    ends = np.flatnonzero(last) + 1
    wide = np.uint16 if bounds[-1] <= 1 << 16 else np.uint32
    return {
        "first_free": first_free, "rounds": bounds, "left": left.astype(wide).tobytes(), "right": right.astype(wide).tobytes(),
        "lengths": lengths[first_free:].astype(np.uint32).tobytes(), "symbols": seq.astype(wide).tobytes(),
        "symbol_starts": np.concatenate(([0], ends)).astype(np.int64).tolist(), "id_starts": counts_docs.astype(np.int64).tolist()}


def _expand(symbols: np.ndarray, block: dict) -> np.ndarray:
    bounds, free = block["rounds"], block["first_free"]
    wide = np.uint16 if bounds[-1] <= 1 << 16 else np.uint32
    left, right = np.frombuffer(block["left"], wide), np.frombuffer(block["right"], wide)
    for a, b in reversed(list(zip(bounds, bounds[1:]))):
        rule = (symbols >= a) & (symbols < b)
        if not rule.any():
            continue
        place = np.cumsum(rule) - rule + np.arange(len(symbols))
        out = np.empty(len(symbols) + int(rule.sum()), symbols.dtype)
        out[place] = symbols
        which = symbols[rule].astype(np.int64) - free
        out[place[rule]] = left[which]
        out[place[rule] + 1] = right[which]
        symbols = out
    return symbols


def decode(block: dict, start: int | None = None, stop: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a block, expanding only the symbols that cover them."""
    bounds, free = block["rounds"], block["first_free"]
    wide = np.uint16 if bounds[-1] <= 1 << 16 else np.uint32
    symbols = np.frombuffer(block["symbols"], wide)
    if start is None and stop is None:
        return _expand(symbols, block)
    lengths = np.concatenate((np.ones(free, np.int64), np.frombuffer(block["lengths"], np.uint32)))
    ends = np.cumsum(lengths[symbols])
    total = int(ends[-1]) if len(ends) else 0
    start, stop = max(0, start or 0), total if stop is None else min(stop, total)
    if start >= stop:
        return symbols[:0]
    a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
    before = int(ends[a - 1]) if a else 0
    return _expand(symbols[a:b], block)[start - before : stop - before]


# --- Spark --------------------------------------------------------------------------------------------------------

SCHEMA = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("id_starts", pa.list_(pa.int64())), ("symbol_starts", pa.list_(pa.int64())),
    ("first_free", pa.int32()), ("rounds", pa.list_(pa.int32())), ("left", pa.binary()), ("right", pa.binary()), ("lengths", pa.binary()), ("symbols", pa.binary())])
_DDL = (
    "shard int, block int, doc_ids array<long>, id_starts array<long>, symbol_starts array<long>, first_free int, rounds array<int>, "
    "left binary, right binary, lengths binary, symbols binary")


def write_shards(
    docs: DataFrame, path: str, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, block: int = BLOCK,
) -> None:
    """Encode all texts, append ``end_id`` to each, and write shards in ascending id order (null ids first).

    Null texts are empty and give the end id alone. Repeated rows stay; rows of one id are ordered by a hash of the
    text, and a hot id may be cut over several shards. A document longer than ``block`` ids has a block of its own. An
    empty table writes no block.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, ids, sizes, names = TaskContext.get().partitionId(), 0, [], [], []
        words = encoder(tokenizer)
        end = np.array([end_id], words.dtype)

        def flush() -> pa.RecordBatch:
            starts = np.concatenate(([0], np.cumsum(sizes)))
            row = {"shard": shard, "block": number, "doc_ids": list(names)} | compress(np.concatenate(ids), starts, max(words.first_free, end_id + 1))
            return pa.RecordBatch.from_pylist([row], SCHEMA)

        held = 0
        for batch in batches:
            texts, keys = batch.column(1), batch.column(0).to_pylist()
            per = max(1, AT_ONCE * len(keys) // max(1, texts.nbytes))
            for a in range(0, len(keys), per):
                for name, got in zip(keys[a : a + per], words.encode_all(texts.slice(a, per))):
                    ids += [got, end]
                    sizes.append(len(got) + 1)
                    names.append(name)
                    held += len(got) + 1
                    if held >= block:
                        yield flush()
                        number, held = number + 1, 0
                        ids, sizes, names = [], [], []
        if sizes:
            yield flush()
        release()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    keys = ["doc_id", "th", "row"]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    rows.mapInArrow(encode, _DDL).write.option("compression", "zstd").parquet(path)


def read_index(spark: SparkSession, path: str, *, crc: bool = True) -> DataFrame:
    """One row per document read back: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``, ``shard``, ``block``."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode(row).astype("<u4")
                starts = row["id_starts"]
                if len(ids) != starts[-1]:
                    raise ValueError(f"shard {row['shard']}, block {row['block']}: {len(ids)} ids, not {starts[-1]}")
                spans = list(zip(starts, starts[1:]))
                yield pa.RecordBatch.from_pydict({
                    "shard": [row["shard"]] * len(spans), "block": [row["block"]] * len(spans), "doc_id": row["doc_ids"], "inside": starts[:-1],
                    "n_tokens": [b - a for a, b in spans], "ids_crc32": [zlib.crc32(ids[a:b]) for a, b in spans]},
                    pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("doc_id", pa.int64()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]))

    blocks = spark.read.parquet(path)
    sizes = blocks.select("shard", "block", F.element_at("id_starts", -1).alias("n"))
    # start of a shard: a window over one row per shard; start of a block: a window inside its shard
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    upto = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = shards.select("shard", upto(Window.orderBy("shard")).alias("shard_start"))
    places = sizes.select("shard", "block", upto(Window.partitionBy("shard").orderBy("block")).alias("block_start")).join(shards, "shard")
    docs = blocks.mapInArrow(digest, "shard int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return docs.join(places, ["shard", "block"]).select(
        "doc_id", (F.col("shard_start") + F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "shard", "block")
