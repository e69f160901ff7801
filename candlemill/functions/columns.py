"""Small column helpers shared by the operators (all JVM expressions)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

EPS = 1e-12


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def safe_tanh(value: Column) -> Column:
    return F.tanh(clip(value, -20.0, 20.0))


def sigmoid(value: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(value, -700.0, 700.0)))


def sign_eps(value: Column, eps: float = 1e-15) -> Column:
    return F.when(value > eps, F.lit(1.0)).when(value < -eps, F.lit(-1.0)).otherwise(F.lit(0.0))


def tick_floor(value: Column, tick: float) -> Column:
    return F.floor(value / F.lit(float(tick))).cast("double") * F.lit(float(tick))


def tick_ceil(value: Column, tick: float) -> Column:
    return F.ceil(value / F.lit(float(tick))).cast("double") * F.lit(float(tick))


def ratio(num: Column, den: Column, default: float | None = None) -> Column:
    """num/den that is NULL (or the default) on a zero or missing denominator."""
    out = F.try_divide(num.cast("double"), den.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def null_if_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def canonical_hash(columns: Sequence[Column | str], length: int = 16) -> Column:
    """Identity of a row: sha256 over its canonical JSON, cut to ``length`` hex characters."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, length)


def median_of(values: Column) -> Column:
    """Exact median of an array column; NULL on an empty array."""
    ordered = F.sort_array(values)
    n = F.size(ordered)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2.0)


def diffs(values: Column) -> Column:
    """One-step differences of an array column."""
    return F.zip_with(
        F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))),
        F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))),
        lambda b, a: b - a,
    )


def half_away(x: Column, digits: int = 0) -> Column:
    """``x`` rounded in binary arithmetic, halves away from zero: scale, round, scale back.

    ``F.round`` rounds the shortest decimal text of a double instead, which differs where the scaled value lies on a half or next to one. Values too
    large to be scaled stay.
    """
    scale = F.lit(10.0**digits)
    y = x.cast("double") * scale
    whole = F.rint(y)  # halves to even, so only halves are moved
    out = F.when(F.abs(y - whole) == 0.5, y + F.signum(y) * 0.5).otherwise(whole) / scale
    return F.when(F.isnan(out) | (F.abs(out) == float("inf")), x.cast("double")).otherwise(out)


def ln(x: Column) -> Column:
    """Natural logarithm with minus infinity at zero (``F.log`` gives NULL there, which averages then skip)."""
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(F.log(x))


def divide(num: Column, den: Column) -> Column:
    """num / den as floating point has it: infinite or not a number over a zero, never an error."""
    return F.when(den == 0, num.cast("double") * float("inf")).otherwise(F.try_divide(num.cast("double"), den.cast("double")))
