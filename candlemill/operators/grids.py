"""Experiment grids and canonical configurations as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

def weight_mixes(base: DataFrame, names: Sequence[str], units: int, min_active: int = 1, max_active: int | None = None) -> DataFrame:
    """Every split of ``units`` equal parts over the non-empty subsets of ``names``.

    One column at a time is exploded to the parts still unspent, so no combination that would have
    to be filtered out later is ever produced. ``base`` rows (the parameter points) are kept.
    """
    max_active = len(names) if max_active is None else max_active
    out = base.withColumns({"_left": F.lit(units), "_active": F.lit(0)})
    for i, n in enumerate(names):
        last = i == len(names) - 1
        parts = F.array(F.col("_left")) if last else F.sequence(F.lit(0), F.col("_left"))
        out = out.withColumn(f"u_{n}", F.explode(parts)).withColumns({
            "_left": F.col("_left") - F.col(f"u_{n}"),
            "_active": F.col("_active") + (F.col(f"u_{n}") > 0).cast("int"),
        }).filter(F.col("_active") <= max_active)
    return out.filter(F.col("_active") >= min_active).select(
        *base.columns, *[(F.col(f"u_{n}") / units).alias(f"w_{n}") for n in names])


def expand_grid(base: DataFrame, grid: Mapping[str, Sequence]) -> DataFrame:
    """Cartesian product of the listed parameter values, added to every row of ``base``."""
    for name in sorted(grid):
        if not grid[name]:
            raise ValueError(f"no values for {name}")
        base = base.withColumn(name, F.explode(F.array(*[F.lit(v) for v in grid[name]])))
    return base


def mix_label(names: Sequence[str], overrides: Sequence[str] = ()) -> Column:
    """Readable label: active weights, then overrides."""
    parts = [F.when(F.col(f"w_{n}") > 0, F.format_string(f"{n}:%s", F.round(F.col(f"w_{n}"), 4).cast("string"))) for n in names]
    head = F.concat_ws("+", *parts)
    if not overrides:
        return head
    return F.concat(head, F.lit("|"), F.concat_ws(",", *[F.format_string(f"{o}=%s", F.col(o).cast("string")) for o in sorted(overrides)]))


def canonical_config(df: DataFrame, defaults: Mapping[str, Mapping[str, object]]) -> DataFrame:
    """Reset the settings of inactive components (weight 0) to their defaults, then normalise weights."""
    total = sum((F.col(f"w_{c}") for c in list(defaults)[1:]), F.col(f"w_{list(defaults)[0]}"))
    resets = {
        name: F.when(F.col(f"w_{comp}") > 0, F.col(name)).otherwise(F.lit(value))
        for comp, settings in defaults.items() for name, value in settings.items()
    }
    return df.withColumns(resets).withColumn("_total", total).withColumns(
        {f"w_{c}": F.round(F.col(f"w_{c}") / F.col("_total"), 12) for c in defaults}).drop("_total")


def with_identity(df: DataFrame, columns: Sequence[str], name: str = "structure_id") -> DataFrame:
    return df.withColumn(name, F.concat(F.lit("ST-"), F.substring(F.sha2(F.to_json(F.struct(*sorted(columns))), 256), 1, 16)))


def scenario_grid(
    base: DataFrame, grid: Mapping[str, Sequence], names: Sequence[str], units: int,
    defaults: Mapping[str, Mapping[str, object]], limit: int = 0,
) -> DataFrame:
    """Parameter grid x weight mixes, canonicalised and de-duplicated by identity."""
    x = canonical_config(weight_mixes(expand_grid(base, grid), names, units), defaults)
    columns = [*grid, *[f"w_{n}" for n in names]]
    out = with_identity(x, columns).dropDuplicates([*base.columns, "structure_id"]).withColumn(
        "label", mix_label(names, list(grid)))
    return out.orderBy(*base.columns, "structure_id").limit(limit) if limit else out


def override(struct: Column, values: Mapping[str, Column]) -> Column:
    """Set dotted fields of a nested config struct at once; one path may not contain another."""
    paths = sorted(values)
    for a, b in zip(paths, paths[1:]):
        if b == a or b.startswith(a + "."):
            raise ValueError(f"overlapping overrides: {a} and {b}")
    for path in paths:
        struct = struct.withField(path, values[path])
    return struct


def config_diff(df: DataFrame, keys: Sequence[str], before: str, after: str, paths: Sequence[str]) -> DataFrame:
    """Minimal list of dotted fields that differ between two config structs of each row."""
    item = lambda p: F.struct(
        F.lit(p).alias("path"), F.col(f"{before}.{p}").cast("string").alias("old_value"), F.col(f"{after}.{p}").cast("string").alias("new_value"))
    x = df.select(*keys, F.explode(F.array(*[item(p) for p in paths])).alias("d"))
    return x.select(*keys, "d.*").filter(~F.col("old_value").eqNullSafe(F.col("new_value")))


def design_draws(df: DataFrame, key: Column, seed: str, weights: Sequence[str], floor: float = 0.05) -> DataFrame:
    """Uniform, log-uniform and floored Dirichlet(1) draws per row, from a hash of the row key.

    Hash draws give the same design on every run and partitioning; they agree with the usual
    distributions statistically, not bit by bit.
    """
    from candlemill.operators.dataset import hash_fraction

    u = lambda tag: hash_fraction(F.concat_ws("|", F.lit(seed), F.lit(tag), key.cast("string")))
    out = df.withColumns({
        "uniform_draw": 1.0 + u("uniform") * 2.0,
        "log_uniform_draw": F.exp(F.log(F.lit(0.001)) + u("log") * (F.log(F.lit(0.1)) - F.log(F.lit(0.001)))),
        **{f"_g_{w}": -F.log(1.0 - u(w)) for w in weights},
    })
    total = sum((F.col(f"_g_{w}") for w in weights[1:]), F.col(f"_g_{weights[0]}"))
    free = 1.0 - floor * len(weights)
    return out.withColumn("_gt", total).withColumns(
        {f"w_{w}": floor + free * F.col(f"_g_{w}") / F.col("_gt") for w in weights}).drop("_gt", *[f"_g_{w}" for w in weights])
