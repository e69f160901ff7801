"""Katz backoff by dictionaries, for comparison."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from candlemill.llm import katz
from candlemill.llm.text_arrays import mix, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _key(word):
    if word == "<end>":
        return katz.END
    if word == "<bos>":
        return katz.BOS
    data = np.frombuffer(word.encode(), np.uint8)
    return word_hashes(data, np.array([0, len(data)]))[0][0]


def scores(rows, tables=16):
    """rows: (doc_id, text); returns {index: (n_tokens, n_known, N, base, score)}."""
    texts = [[*WORD.findall(_lower(t)), "<end>"] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    uni, pair = Counter(), Counter()
    for t, out in zip(texts, held):
        if not out:
            uni.update(t)
            pair.update(zip(["<bos>", *t], t))
    n, v = sum(uni.values()), len(uni)
    of = lambda counts: [0] + [sum(c == r for c in counts) for r in range(1, katz.CUTOFF + 2)]
    d1 = katz.discounts(of(uni.values()))
    cut = lambda c, d: d[c] * c if c <= katz.CUTOFF else c - katz.REST
    unknown = 1 - sum(cut(c, d1) for c in uni.values()) / n if n else 1.0
    hot = {w for w, c in uni.items() if c > max(n / katz.HOT, 1000)}

    def table(h, w):
        k = mix(np.array([_key(w)], np.uint64))
        if w in hot:
            k = mix(k ^ mix(np.array([_key(h)], np.uint64)))
        return int(k[0] % np.uint64(tables))

    place = {p: table(*p) for p in pair}
    by = defaultdict(list)
    for p, c in pair.items():
        by[place[p]].append(c)
    d2 = {t: katz.discounts(of(c)) for t, c in by.items()}
    p1 = lambda w: cut(uni[w], d1) / n if uni[w] else unknown
    mass, total, lower = Counter(), Counter(), Counter()
    for (h, w), c in pair.items():
        mass[h] += cut(c, d2[place[h, w]])
        total[h] += c
        lower[h] += p1(w)
    out = {}
    for i, t in enumerate(texts):
        score = base = 0.0
        for h, w in zip(["<bos>", *t], t):
            base += math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1)))
            c = pair.get((h, w), 0)
            if c:
                score += math.log10(cut(c, d2[place[h, w]]) / total[h])
            elif total[h]:
                score += math.log10((1 - mass[h] / total[h]) / (1 - lower[h]) * p1(w))
            else:
                score += math.log10(p1(w))
        out[i] = (len(t), sum(uni[w] > 0 for w in t), n, base, score)
    return out
