"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows; everything else about quality is learnt from unlabelled text. A first classifier of
positives against unlabelled text ranks texts; the class prior is the least ratio of the unlabelled to the positive
share above a score (no set of texts can hold less than the prior's share of it). The final linear model minimises the
non-negative unbiased risk  prior * E_P[loss(f, +)] + max(0, E_U[loss(f, -)] - prior * E_P[loss(f, -)]).

The model is fitted on bounded samples (``positives``, ``unlabelled`` rows, by hash of the id). Every text is scored
whole, in one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from candlemill.llm.columns import id_remainder
from candlemill.llm.text_arrays import release, text_pieces, word_hashes

_KIND = np.full(256, 5, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 sentence marks, 4 other symbols, 5 beyond ASCII, 6 space
_KIND[:128] = 4
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
_KIND[[ord(c) for c in ".,;:'\"()-!?"]] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 6
_CLOSE = np.zeros(256, np.uint8)
_CLOSE[[ord(c) for c in ".,;:"]] = 1
_CLOSE[[ord(c) for c in "!?"]] = 2
_CLOSE[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-"]] = 3
WIDTH = 19


def _features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    texts = len(offsets) - 1
    out = np.zeros((texts, WIDTH), np.float64)
    n = len(data)
    if not n:
        return out
    words, at = word_hashes(data, offsets)
    row = np.repeat(np.arange(texts), np.diff(offsets))
    kinds = np.bincount(row * 8 + _KIND[data], minlength=texts * 8).reshape(texts, 8)
    visible = np.maximum(kinds[:, :6].sum(1), 1)
    count = np.diff(at)
    some = np.maximum(count, 1)
    out[:, 0] = np.log1p(count)
    out[:, 1:7] = kinds[:, :6] / visible[:, None]
    out[:, 7] = visible / some
    letters = np.maximum(kinds[:, 0] + kinds[:, 1], 1)
    out[:, 8] = kinds[:, 1] / letters
    out[:, 9] = np.bincount(row, weights=data == 10, minlength=texts) / some
    # the last byte of each word
    space = _KIND[data] == 6
    closing = ~space
    closing[:-1] &= space[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    closing[ends] = ~space[ends]
    mark = _CLOSE[data]
    for k in (1, 2, 3):
        out[:, 9 + k] = np.bincount(row, weights=closing & (mark == k), minlength=texts) / some
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        if b - a < 2:
            out[i, 13:16] = (0.0, 1.0, 1.0 if b > a else 0.0)
            continue
        own = words[a:b]
        _, often = np.unique(own, return_counts=True)
        out[i, 13] = np.count_nonzero(own[1:] == own[:-1]) / (b - a - 1)
        out[i, 14] = len(often) / (b - a) ** 0.9
        out[i, 15] = often.max() / (b - a)
        pair = own[1:] * np.uint64(3) + own[:-1]
        out[i, 16] = len(np.unique(pair)) / (b - a - 1)
    bare = closing.copy()  # one-byte words
    bare[1:] &= space[:-1]
    starts = offsets[:-1][offsets[:-1] < n]
    bare[starts] = closing[starts]
    out[:, 17] = np.bincount(row, weights=bare & (_KIND[data] == 4), minlength=texts) / some
    out[:, 18] = np.bincount(row, weights=(_KIND[data] == 1) & np.concatenate(([False], _KIND[data][:-1] == 1)), minlength=texts) / visible
    return out


def features(column: pa.Array) -> np.ndarray:
    """Text statistics of whole texts, one row a text. An empty or null text has zeros."""
    parts = [_features(data, offsets) for _, data, offsets in text_pieces(column)]
    release()
    return np.concatenate(parts) if parts else np.zeros((0, WIDTH))


@dataclass
class Model:
    center: np.ndarray
    scale: np.ndarray
    edges: np.ndarray  # WIDTH x bins
    weights: np.ndarray
    prior: float

    def spread(self, x: np.ndarray) -> np.ndarray:
        """Standardised values and ``value above edge`` steps, with a constant."""
        z = np.clip((x - self.center) / self.scale, -4, 4)
        steps = (x[:, :, None] > self.edges[None]).reshape(len(x), -1)
        return np.concatenate([np.ones((len(x), 1)), z, steps], axis=1)

    def spread_rows(self, x: np.ndarray) -> np.ndarray:
        """``spread`` of a whole table in single precision, built in blocks: the double form never stands as a whole."""
        out = np.empty((len(x), 1 + x.shape[1] + self.edges.size), np.float32)
        for a in range(0, len(x), 1024):
            out[a : a + 1024] = self.spread(x[a : a + 1024])
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for a in range(0, len(x), 1024):
            out[a : a + 1024] = 1 / (1 + np.exp(-np.clip(self.spread(x[a : a + 1024]) @ self.weights, -40, 40)))
        return out


def _descend(gradient, n: int, rounds: int = 400, step: float = 0.05) -> np.ndarray:
    w, m, v = np.zeros(n), np.zeros(n), np.zeros(n)
    for t in range(1, rounds + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.5) -> float:
    """Least ratio of the unlabelled to the positive share above a score, over scores that keep ``least`` of the positives.

    The least of many noisy ratios lies too low, so each is taken at one standard error above; that fades as samples grow.
    """
    cuts = np.quantile(positive, np.linspace(0, 1 - least, 101))
    p, u = np.sort(positive), np.sort(unlabelled)
    tail_p = 1 - np.searchsorted(p, cuts, "left") / len(p)
    tail_u = 1 - np.searchsorted(u, cuts, "left") / len(u)
    high = tail_u + np.sqrt(tail_u * (1 - tail_u) / len(u))
    low = tail_p - np.sqrt(tail_p * (1 - tail_p) / len(p))
    return float(np.clip((high / np.maximum(low, 1e-9)).min(), 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, penalty: float | None = None, bins: int = 8) -> Model | None:
    """The model from two feature tables; None without rows on either side (every score is then 0.5).

    ``penalty`` on squared weights defaults to 0.7 / positives, between 1e-4 and 1e-2.
    """
    if not len(positive) or not len(unlabelled):
        return None
    penalty = min(1e-2, max(1e-4, 0.7 / len(positive))) if penalty is None else penalty
    scale = unlabelled.std(0)
    edges = np.quantile(unlabelled, np.linspace(0, 1, bins + 2)[1:-1], axis=0).T
    # tails hold the rare kinds of text
    tails = np.quantile(unlabelled, [0.01, 0.03, 0.06, 0.94, 0.97, 0.99], axis=0).T
    model = Model(unlabelled.mean(0), np.where(scale > 1e-9, scale, 1.0), np.concatenate([edges, tails], axis=1), np.zeros(0), 0.5)
    # every other positive fits the first model, the others judge it; products stay in single precision, sums are means
    order = np.concatenate([np.arange(0, len(positive), 2), np.arange(1, len(positive), 2)])
    xp, xu = model.spread_rows(positive[order]), model.spread_rows(unlabelled)
    size, half = xp.shape[1], (len(xp) + 1) // 2
    fitted, judged = xp[:half], xp[half:] if len(xp) > 1 else xp

    def apart(weights: np.ndarray) -> np.ndarray:
        w = weights.astype(np.float32)
        gp, gu = _sigmoid(fitted @ w) - 1, _sigmoid(xu @ w)
        return fitted.T @ gp / len(fitted) + xu.T @ gu / len(xu) + penalty * w

    w = _descend(apart, size, 200).astype(np.float32)
    model.prior = prior = estimate_prior(judged @ w, xu @ w)

    def risk(weights: np.ndarray) -> np.ndarray:
        w = weights.astype(np.float32)
        zp, zu = xp @ w, xu @ w
        sp, su = _sigmoid(zp), _sigmoid(zu)
        # logistic loss; the loss of a negative is log(1 + exp(z))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_negative = xu.T @ su / len(xu) - prior * (xp.T @ sp) / len(xp)
        g_positive = prior * (xp.T @ (sp - 1)) / len(xp)
        # below zero the estimate has overfitted: step back along it
        return (g_positive + g_negative if negative >= 0 else -g_negative) + penalty * w

    model.weights = _descend(risk, size)
    return model


def _sample(docs: DataFrame, ids: DataFrame, text: str, doc_id: str) -> np.ndarray:
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(ids), "id")

    def run(batches):
        for batch in batches:
            x = features(batch.column(1)).astype(np.float32)
            flat = pa.array(x.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * WIDTH, pa.int32()), flat)], names=["id", "x"])

    got = rows.select("id", "text").mapInArrow(run, "id long, x array<float>").toArrow().sort_by("id")
    return np.array(got["x"].combine_chunks().flatten(), np.float64).reshape(-1, WIDTH)


def train(
    docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality", divisor: int = 3, held_out: int = 1,
    positives: int = 20_000, unlabelled: int = 40_000, seed: int = 3,
) -> Model | None:
    """Fit on rows whose crc32(id) mod ``divisor`` is not ``held_out``: up to ``positives`` trusted positives and
    ``unlabelled`` rows, both by the order of a hash of the id. Ids whose labels disagree, and null ids, are not used."""
    learn = id_remainder(F.col("id"), divisor) != held_out
    trusted = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).alias("y")).filter("id IS NOT NULL AND y IS NOT NULL").filter(learn)
    trusted = trusted.groupBy("id").agg(F.min("y").alias("y")).filter("y = 1").select("id")
    known = docs.select(F.col(doc_id).cast("long").alias("id")).filter("id IS NOT NULL").filter(learn).distinct()
    draw = F.xxhash64("id", F.lit(seed))
    sides = [known.join(trusted, "id", "left_semi").orderBy(draw, "id").limit(positives), known.orderBy(draw, "id").limit(unlabelled)]
    return fit(*[_sample(docs.withColumn(doc_id, F.col(doc_id).cast("long")), ids, text, doc_id) for ids in sides])


def score_column(model: Model | None, text: Column) -> Column:
    """Score from 0 to 1 of whole texts; 0.5 for all when there was nothing to learn from."""
    if model is None:
        return F.lit(0.5)

    def score(column: pa.Array) -> pa.Array:
        return pa.array(model.score(features(column)), pa.float64())

    return F.arrow_udf(score, "double")(F.coalesce(text, F.lit("")))
