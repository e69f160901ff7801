"""Student-t in SQL text, by the finite trigonometric series for whole degrees of freedom.

This is a second derivation, independent of the incomplete beta function the library uses.
"""

from __future__ import annotations

import math


def tail_expr(t: str, n: str) -> str:
    """SQL for P(T > t) with whole n >= 1."""
    th = f"atan(({t}) / sqrt(({n})::DOUBLE))"
    even = (
        f"sin({th}) * (1 + coalesce(list_sum(list_transform(range(1, CAST(({n}) / 2 AS BIGINT)), "
        f"lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow(cos({th}), 2 * k))), 0))"
    )
    odd = (
        f"2 / pi() * ({th} + CASE WHEN ({n}) = 1 THEN 0 ELSE sin({th}) * cos({th}) * (1 + coalesce(list_sum(list_transform("
        f"range(1, CAST((({n}) - 1) // 2 AS BIGINT)), lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5)) "
        f"* pow(cos({th}), 2 * k))), 0)) END)"
    )
    return f"((1 - CASE WHEN ({n}) % 2 = 0 THEN {even} ELSE {odd} END) / 2)"


def _central(t: float, n: int) -> float:
    th = math.atan(t / math.sqrt(n))
    c, s = math.cos(th), math.sin(th)
    if n % 2 == 0:
        term = total = 1.0
        for j in range(1, n // 2):
            term *= (2 * j - 1) / (2 * j) * c * c
            total += term
        return s * total
    if n == 1:
        return 2 * th / math.pi
    term = total = 1.0
    for j in range(1, (n - 1) // 2):
        term *= (2 * j) / (2 * j + 1) * c * c
        total += term
    return 2 / math.pi * (th + s * c * total)


def critical_95(n: int) -> float:
    low, high = 0.0, 20.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _central(mid, n) < 0.95 else (low, mid)
    return (low + high) / 2


def critical_cte(up_to: int = 199) -> str:
    rows = ", ".join(f"({n}, {critical_95(n)!r}::DOUBLE)" for n in range(1, up_to + 1))
    return f"tcrit(df, tc) AS (VALUES {rows})"


def ci_columns(n: str, m: str, sd: str, name: str, digits: int = 8) -> str:
    """mean, low, high; needs ``tcrit`` joined on df = n - 1 under the alias ``tc_<name>``."""
    half = f"tc_{name}.tc * {sd} / sqrt({n})"
    low = f"CASE WHEN {n} < 2 THEN NULL WHEN {sd} = 0 THEN {m} ELSE {m} - {half} END"
    high = f"CASE WHEN {n} < 2 THEN NULL WHEN {sd} = 0 THEN {m} ELSE {m} + {half} END"
    return low, high


def p_expr(n: str, m: str, sd: str) -> str:
    t = f"{m} / nullif({sd} / sqrt({n}), 0)"
    return (
        f"CASE WHEN {n} < 2 THEN 1.0 WHEN {sd} = 0 THEN CASE WHEN {m} > 0 THEN 0.0 ELSE 1.0 END "
        f"ELSE {tail_expr(t, f'({n} - 1)')} END"
    )
