"""Window building blocks that never put a whole series into one task.

A price series may hold a third of all rows, so ``Window.partitionBy(run_id)`` is avoided for
data-sized frames. Two shapes replace it:

* **halo chunks** for bounded frames: a series is cut every ``CHUNK`` bars and each chunk receives
  copies of the few neighbouring bars its frames reach into;
* **bucketed scans** for running aggregates and ranks: totals per bucket, a running total over the
  (small) bucket table, and a running aggregate inside each bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK = 4096


def spread_halo(
    df: DataFrame, back: int, ahead: int = 0, *, index: str = "bar_index", chunk: int = CHUNK
) -> DataFrame:
    """Copy rows near a chunk edge into the neighbouring chunk; ``_core`` marks the owner copy."""
    chunk = max(chunk, back, ahead)  # a halo reaches into the next chunk only
    own = F.floor(F.col(index) / chunk).cast("long")
    offset = F.col(index) % chunk
    targets = [own]
    if back:
        targets.append(F.when(offset >= chunk - back, own + 1))
    if ahead:
        targets.append(F.when((offset < ahead) & (own > 0), own - 1))
    out = df.withColumn("_own", own)
    if len(targets) == 1:
        return out.withColumn("_chunk", F.col("_own")).withColumn("_core", F.lit(True)).drop("_own")
    return (
        out.withColumn("_chunk", F.explode(F.array_compact(F.array(*targets))))
        .withColumn("_core", F.col("_chunk") == F.col("_own"))
        .drop("_own")
    )


def spread_chunks(df: DataFrame, *keys: str) -> DataFrame:
    """Hash the chunks over ``spark.sql.shuffle.partitions`` tasks by number, so that small but CPU-heavy
    chunks are not merged into a few tasks by their byte size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def chunk_window(run: Sequence[str] = ("run_id",), index: str = "bar_index"):
    return Window.partitionBy(*run, "_chunk").orderBy(index)


def over_halo(
    df: DataFrame,
    back: int,
    build,
    *,
    ahead: int = 0,
    run: Sequence[str] = ("run_id",),
    index: str = "bar_index",
    chunk: int = CHUNK,
) -> DataFrame:
    """Add bounded-frame window columns. ``build(w)`` returns one dict of columns, or a list of
    dicts when later columns read earlier ones."""
    out = spread_halo(df, back, ahead, index=index, chunk=chunk)
    stages = build(chunk_window(run, index))
    for stage in [stages] if isinstance(stages, Mapping) else stages:
        out = out.withColumns(dict(stage))
    return out.filter("_core").drop("_core", "_chunk")


def sliding_extremes(w, length: int, end: int, wanted: Mapping[str, tuple[str, str]], *, fan: int = 5) -> list[dict[str, Column]]:
    """Stages for :func:`over_halo`: max or min over the ``length`` rows that end ``end`` rows before the current one.

    ``wanted`` maps an output name to (max|min, input column). Extremes of ``fan`` rows are put together from lags, those of ``fan`` times as
    many from them, and so on, so a row costs a few lags and not ``length`` comparisons. Helper columns are named
    ``_x<level>_<output>``. Rows before the first count as absent, as in a frame.
    """
    pick = lambda kind, lags: (F.greatest if kind == "max" else F.least)(*lags) if len(lags) > 1 else lags[0]
    back = lambda src, k: F.lag(src, k).over(w) if k else F.col(src)
    now, held, stages = {name: src for name, (_, src) in wanted.items()}, 1, []
    while held * fan < length:
        level = len(stages)
        stages.append({f"_x{level}_{name}": pick(kind, [back(now[name], held * i) for i in range(fan)]) for name, (kind, _) in wanted.items()})
        now, held = {name: f"_x{level}_{name}" for name in wanted}, held * fan
    starts = sorted({*range(0, length - held, held), length - held})
    stages.append({name: pick(kind, [back(now[name], end + k) for k in starts]) for name, (kind, _) in wanted.items()})
    return stages


_FUNCS = {"sum": F.sum, "max": F.max, "min": F.min}


def _combine(kind: str, prefix: Column, inside: Column) -> Column:
    if kind == "sum":
        return F.coalesce(prefix, F.lit(0)) + F.coalesce(inside, F.lit(0))
    return (F.greatest if kind == "max" else F.least)(prefix, inside)


def bucketed_scan(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[Column | str],
    scans: Mapping[str, tuple[str, str]],
    *,
    reverse: bool = False,
    exclusive: bool = False,
) -> DataFrame:
    """Running aggregates ordered by (bucket, order) inside ``keys``; the row itself counts unless
    ``exclusive``.

    ``scans`` maps an output name to (sum|max|min, input column). With ``reverse`` the scan runs
    from the last bucket backwards and ``order`` must be given in that direction too. The bucket
    table is aggregated map-side; its window holds one row per bucket, not per input row.
    """
    keys = list(keys)
    totals = df.groupBy(*keys, bucket).agg(
        *[_FUNCS[kind](src).alias(f"_t_{name}") for name, (kind, src) in scans.items()]
    )
    edge = F.col(bucket).desc() if reverse else F.col(bucket)
    before = Window.partitionBy(*keys).orderBy(edge).rowsBetween(Window.unboundedPreceding, -1)
    prefix = totals.select(
        *keys, bucket,
        *[_FUNCS[kind](f"_t_{name}").over(before).alias(f"_p_{name}") for name, (kind, _) in scans.items()],
    )
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1 if exclusive else 0)
    out = df.withColumns({f"_i_{name}": _FUNCS[kind](src).over(inside) for name, (kind, src) in scans.items()})
    out = out.join(prefix, [*keys, bucket])
    out = out.withColumns(
        {name: _combine(kind, F.col(f"_p_{name}"), F.col(f"_i_{name}")) for name, (kind, _) in scans.items()}
    )
    return out.drop(*[f"_{p}_{name}" for name in scans for p in "pi"])


def bucketed_rank(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[Column | str],
    name: str = "rank",
    *,
    reverse: bool = False,
) -> DataFrame:
    """1-based row number in (bucket, order) without sorting a whole key in one task."""
    marked = df.withColumn("_one", F.lit(1).cast("long"))
    return bucketed_scan(marked, keys, bucket, order, {name: ("sum", "_one")}, reverse=reverse).drop("_one")
