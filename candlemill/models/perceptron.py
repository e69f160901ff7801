"""A small perceptron (64-32-16) trained by distributed gradient rounds, its epoch chosen on validation.

Each round sends the weights out with the task, every partition sums the gradient of its rows of the mini-batch in numpy, and
Spark sums the partitions' gradients element by element, so that the driver meets one number for each weight. Mini-batches
and dropout masks follow from a hash of the row, never from its partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from candlemill.sources.series import written

HIDDEN = (64, 32, 16)
DROPPED = 0.2
CLIP = 5.0


def shapes(width: int) -> list[tuple[int, int]]:
    sizes = [width, *HIDDEN, 1]
    return list(zip(sizes, sizes[1:]))


def start_weights(width: int, seed: int) -> np.ndarray:
    """Weights and biases of all layers in one vector, uniform within 1 / sqrt(inputs)."""
    draw = np.random.default_rng(seed)
    return np.concatenate([draw.uniform(-1, 1, (a + 1) * b) / math.sqrt(a) for a, b in shapes(width)])


def layers(flat: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in shapes(width):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + (a + 1) * b]))
        at += (a + 1) * b
    return out


def keep_mask(draw: np.ndarray, step: int) -> np.ndarray:
    """Which units of the first layer a row keeps at a step, from the row's hash alone."""
    with np.errstate(over="ignore"):
        h = draw.astype(np.uint64)[:, None] + np.uint64(step + 1) * np.uint64(0x9E3779B97F4A7C15) + np.arange(HIDDEN[0], dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53 >= DROPPED


def forward(flat: np.ndarray, x: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Log odds of every row, and the inputs of each layer."""
    seen, net = [x], layers(flat, x.shape[1])
    for i, (w, b) in enumerate(net[:-1]):
        h = np.maximum(seen[-1] @ w + b, 0.0)
        if i == 0 and mask is not None:
            h = h * mask / (1.0 - DROPPED)
        seen.append(h)
    w, b = net[-1]
    return (seen[-1] @ w + b)[:, 0], seen


def losses(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z) - y * z


def gradient(flat: np.ndarray, x: np.ndarray, y: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Summed gradient of the log loss over the rows, and the summed loss."""
    z, seen = forward(flat, x, mask)
    net = layers(flat, x.shape[1])
    back = (1.0 / (1.0 + np.exp(-np.clip(z, -700, 700))) - y)[:, None]
    parts = []
    for i in range(len(net) - 1, -1, -1):
        parts.append(np.concatenate([(seen[i].T @ back).ravel(), back.sum(axis=0)]))
        if i:
            back = (back @ net[i][0].T) * (seen[i] > 0)
            if i == 1 and mask is not None:
                back = back / (1.0 - DROPPED)
    return np.concatenate(parts[::-1]), float(losses(z, y).sum())


class AdamW:
    def __init__(self, n: int, rate: float, decay: float = 1e-4):
        self.m, self.v, self.t, self.rate, self.decay = np.zeros(n), np.zeros(n), 0, rate, decay

    def step(self, weights: np.ndarray, grad: np.ndarray) -> np.ndarray:
        norm = float(np.sqrt((grad * grad).sum()))
        grad = grad * min(1.0, CLIP / (norm + 1e-6))
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad * grad
        ahead = self.m / (1 - 0.9**self.t) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)
        return weights * (1 - self.rate * self.decay) - self.rate * ahead


@dataclass(frozen=True)
class Perceptron:
    """Weights of the best epoch and the validation loss after each epoch."""

    weights: np.ndarray
    width: int
    history: tuple[float, ...]
    best_epoch: int

    def transform(self, df: DataFrame) -> DataFrame:
        weights = self.weights

        @F.pandas_udf("double")
        def odds(x: pd.Series) -> pd.Series:
            return pd.Series(forward(weights, np.stack(x.to_numpy()).astype(np.float64))[0] if len(x) else [], dtype="float64")

        p = 1.0 / (1.0 + F.exp(-odds(vector_to_array("features"))))
        return df.withColumn("_p1", p).withColumn("probability", array_to_vector(F.array(1.0 - F.col("_p1"), F.col("_p1")))).drop("_p1")


def _sums(rows: DataFrame, weights: np.ndarray, width: int, step: int, dropout: bool) -> np.ndarray:
    """Summed gradient, training loss and rows, validation loss and rows over ``rows``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(weights) + 4)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, width)
            y, draw = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "draw"))
            held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
            mine = ~held
            if mine.any():
                grad, loss = gradient(weights, x[mine], y[mine], keep_mask(draw[mine], step) if dropout else None)
                total[:-4] += grad
                total[-4:-2] += loss, mine.sum()
            if held.any():
                total[-2:] += losses(forward(weights, x[held])[0], y[held]).sum(), held.sum()
        yield pa.RecordBatch.from_pydict({"v": pa.array([total], pa.list_(pa.float64()))})

    parts = rows.select("x", "y", "draw", "held").mapInArrow(work, "v array<double>")
    summed = parts.select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("s"))
    out = np.zeros(len(weights) + 4)
    for r in summed.collect():  # one row for each weight
        out[r["pos"]] = r["s"]
    return out


def fit_perceptron(
    train: DataFrame, validation: DataFrame, label: str, key: str, *, seed: int = 42, epochs: int = 60, patience: int = 10,
    batches: int = 2, rate: float = 0.01, dropout: bool = True,
) -> Perceptron:
    """Epochs of ``batches`` gradient rounds until the validation loss has not fallen by 1e-6 for ``patience`` epochs.

    ``key`` names the column whose hash deals rows to mini-batches. The weights of the best epoch are kept. Both tables hold a
    ``features`` vector; an empty one, or a loss that is never finite, raises.
    """
    draw = F.xxhash64(F.col(key).cast("string"), F.lit(seed))
    row = lambda df, held: df.select(vector_to_array("features").alias("x"), F.col(label).cast("double").alias("y"), draw.alias("draw"), F.lit(held).alias("held"))
    rows = written(row(train, False).unionByName(row(validation, True)), "perceptron-rows")
    first = rows.select(F.size("x")).head()
    if first is None:
        raise ValueError("no rows to train on")
    width = first[0]
    weights, best, best_loss, best_epoch, history, step = start_weights(width, seed), None, math.inf, 0, [], 0
    adam = AdamW(len(weights), rate)

    def told(sums: np.ndarray) -> bool:
        """Notes the validation loss of the epoch just ended; true once patience has run out."""
        nonlocal best, best_loss, best_epoch
        loss = float(sums[-2] / sums[-1]) if sums[-1] else math.nan
        history.append(loss)
        if loss < best_loss - 1e-6:
            best, best_loss, best_epoch = weights.copy(), loss, len(history)
        return len(history) - best_epoch >= patience

    for epoch in range(epochs + 1):
        dealt = F.pmod(F.xxhash64("draw", F.lit(epoch)), F.lit(batches))
        for b in range(batches):
            mine = F.col("held") if b == 0 else F.lit(False)
            if epoch < epochs:
                mine = mine | (~F.col("held") & (dealt == b))
            sums = _sums(rows.filter(mine), weights, width, step, dropout)
            if b == 0 and epoch and (told(sums) or epoch == epochs):
                if best is None:
                    raise ValueError("the validation loss was never finite")
                return Perceptron(best, width, tuple(history), best_epoch)
            if sums[-3]:
                weights = adam.step(weights, sums[:-4] / sums[-3])
            step += 1
    raise AssertionError("unreachable")
