"""Whole texts as numpy arrays inside a task: words, their 64-bit hashes, shingles; and groups of sorted batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18  # bytes of text handled at once; a longer text is handled alone

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240101).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[_SPACE] = 0
_STEP = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def release() -> None:
    """Give Arrow's freed memory back to the system: a reused Python worker would keep it beside the next task's."""
    pa.default_memory_pool().release_unused()


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(64, 1 << (n - 1).bit_length())
        _powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, _STEP, np.uint64))))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of MurmurHash3, public domain)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts of about ``PIECE`` bytes. Nulls are empty."""
    array = column.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(array):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        own = offsets[row : stop + 1]
        yield row, data[own[0] : own[-1]], own - own[0]
        row = stop


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased) and, per text, where its words begin (one entry more at the end)."""
    hashes, at, _, _ = word_spans(data, offsets)
    return hashes, at


_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True
_SECOND = np.zeros(256, bool)  # second bytes of the letters U+00C0 to U+00FF
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False


def _tails(data: np.ndarray, begin: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Where marks begin that end a word otherwise of Latin letters. ``begin``: first bytes of words."""
    plain = _ASCII[data]
    pair = np.flatnonzero((data[:-1] == 0xC3) & _SECOND[data[1:]])
    plain[pair] = plain[pair + 1] = True
    mark = marks[data]
    broken = ~(plain | mark | _SPACE[data]) | (mark & begin)
    broken[1:] |= plain[1:] & mark[:-1] & ~begin[1:]
    starts = np.flatnonzero(begin)
    at = np.flatnonzero(mark[1:] & plain[:-1] & ~begin[1:]) + 1
    return at[~np.logical_or.reduceat(broken, starts)[np.searchsorted(starts, at, "right") - 1]]


def word_spans(
    data: np.ndarray, offsets: np.ndarray, fold: bool = True, marks: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``word_hashes``, and the first byte and the end of every word; without ``fold``, A-Z stay as they are.

    ``marks`` (of 256 bytes, those that are marks) parts a word of Latin letters from the marks behind it: two words.
    """
    n, none = len(data), np.zeros(0, np.int64)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none
    low = _LOWER[data] if fold else data
    letter = ~_SPACE[low]
    begin = letter.copy()
    begin[1:] &= ~letter[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    begin[edges] = letter[edges]
    if marks is not None and begin.any():
        begin[_tails(data, begin, marks)] = True
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none
    closing = letter.copy()
    closing[:-1] &= ~letter[1:] | begin[1:]
    place = np.arange(n, dtype=np.int64) - starts[np.maximum(np.cumsum(begin) - 1, 0)]
    place[~letter] = 0
    sums = np.add.reduceat(_BYTE[low] * _power_table(int(place.max()) + 1)[place], starts)
    return mix(sums), np.searchsorted(starts, offsets), starts, np.flatnonzero(closing) + 1


_WEIGHT = np.random.default_rng(7).integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(words: np.ndarray, starts: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of ``width`` words; of the whole text, if it has fewer words."""
    runs = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        runs += mix(words[k : k + len(runs)] * _WEIGHT[k] + np.uint64(k))
    runs = mix(runs)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= width:
            got = np.sort(runs[a : b - width + 1])
            if len(got) > 1:
                keep = np.empty(len(got), bool)
                keep[0] = True
                np.not_equal(got[1:], got[:-1], out=keep[1:])
                got = got[keep]
            out.append(got)
        elif b > a:
            own = words[a:b]
            out.append(mix(np.array([sum(int(x) for x in mix(own * _WEIGHT[: len(own)] + np.uint64(100 + len(own)))) & (2**64 - 1)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of equal ``keys`` (64-bit integers) from batches sorted by them; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(int(c[0]) for c in cols)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(int(c[-1]) for c in cols)
    if held:
        yield pa.Table.from_batches(held)
