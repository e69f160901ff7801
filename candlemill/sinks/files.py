"""Sinks. Spark's commit protocol makes each write appear whole or not at all."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Mapping, Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from candlemill.config import canonical_json
from candlemill.sources.series import written

PIECE = 1 << 23  # bytes of a file that a task holds at once


def exact_text(df: DataFrame) -> DataFrame:
    """Doubles in 17 significant digits, booleans as 0/1, the rest as text."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind == "double":
            c = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.format_string("%.16e", c))
        elif kind == "boolean":
            c = c.cast("int").cast("string")
        out.append(c.cast("string").alias(name))
    return df.select(*out)


def write_history(ticks: DataFrame, path: str) -> None:
    """Tick history as CSV with exact numbers."""
    exact_text(ticks).write.option("header", True).csv(path)


def write_candles(bars: DataFrame, path: str, dataset_id: Column | None = None) -> None:
    cols = ["run_id", "candle_number", "start_step", "end_step", "open", "high", "low", "close", "volume", F.col("is_complete").cast("int").alias("is_complete")]
    df = bars.select(*cols)
    if dataset_id is not None:
        df = df.withColumn("dataset_id", dataset_id)
    df.write.option("header", True).csv(path)


def ragged_union(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows with different columns under one header, columns in first-seen order."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return finite_only(out)


def finite_only(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL."""
    fix = {n: F.when(~F.isnan(n) & (F.abs(F.col(n)) < float("inf")), F.col(n)) for n, k in df.dtypes if k in ("double", "float")}
    return df.withColumns(fix) if fix else df


def write_ragged_csv(frames: Sequence[DataFrame], path: str) -> None:
    ragged_union(frames).write.option("header", True).csv(path)


ACCOUNTING = "fixed_notional_additive_return_points"


def run_metric_table(metrics: DataFrame) -> DataFrame:
    """Run metrics under their report names: sums are return points, not compounded returns."""
    return finite_only(metrics).withColumnsRenamed({
        "total_gross_return": "gross_return_points", "total_transaction_cost": "transaction_cost_return_points",
        "total_net_return": "net_return_points"}).withColumn("return_accounting", F.lit(ACCOUNTING))


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, keys sorted, non-finite numbers as null."""
    clean = finite_only(df)
    clean.select(*sorted(clean.columns)).write.option("ignoreNullFields", False).json(path)


def write_dataset(rows: DataFrame, splits: DataFrame, path: str) -> None:
    """Labelled rows once, laid out by split, clustered by run inside each split."""
    rows.join(splits.select("structure_id", "split"), "structure_id").repartitionByRange("split", "run_id").sortWithinPartitions(
        "split", "run_id").write.partitionBy("split").parquet(path)


def write_rows_csv(rows: DataFrame, path: str, order: Sequence[str]) -> None:
    """Ordered export."""
    rows.orderBy(*order).write.option("header", True).csv(path)


def dataset_manifest(rows: DataFrame, runs: DataFrame, splits: DataFrame, contract: Mapping) -> DataFrame:
    """Counts by split with the identity of the contract that shaped the dataset."""
    identity = "DS-" + hashlib.sha256(canonical_json(dict(contract)).encode()).hexdigest()[:20]
    s = splits.select("structure_id", "split")
    a = rows.join(s, "structure_id").groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    b = runs.join(s, "structure_id").groupBy("split").agg(F.count_distinct("structure_id").alias("structures"), F.count(F.lit(1)).alias("runs"))
    return b.join(a, "split", "left").withColumns({"rows": F.coalesce("rows", F.lit(0).cast("long")), "dataset_id": F.lit(identity)})


def name_below(folder: str, path: Column) -> Column:
    """Path of a file below ``folder``, so that equal names in two sub-folders stay apart and a moved folder keeps its names."""
    root = F.regexp_replace(F.lit(folder.rstrip("/")), "^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?/*", "/")
    whole = F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?/*", "/")
    return F.when(whole == root, F.element_at(F.split(whole, "/"), -1)).otherwise(F.substr(whole, F.char_length(root) + 2))


def artifact_table(spark: SparkSession, folder: str) -> DataFrame:
    """Every file below a folder, by its path below it, with its size and sha256."""
    return file_digests(spark, folder).select(name_below(folder, F.col("path")).alias("file_name"), F.col("length").alias("bytes"), "sha256")


def _digest(path: str) -> str | None:
    """SHA-256 of a file read piece by piece; nothing where Python cannot open the path."""
    from pyarrow import fs

    parts = re.fullmatch("([A-Za-z][A-Za-z0-9+.-]*)://([^/]+)(/.*)", path)
    try:
        if parts:
            system, name = fs.FileSystem.from_uri(f"{parts[1]}://{parts[2]}{quote(parts[3])}")
        else:
            system, name = fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
        with system.open_input_stream(name, compression=None) as stream:
            found = hashlib.sha256()
            while piece := stream.read(PIECE):
                found.update(piece)
            return found.hexdigest()
    except (OSError, ValueError, ImportError):
        return None


def file_digests(spark: SparkSession, folder: str, pattern: str = "*", digest: Callable[[str], str | None] = _digest) -> DataFrame:
    """``path``, ``length`` and ``sha256`` of every file below a folder.

    ``digest`` gives the hash of a path, or nothing where it cannot open it. A task holds one piece of a file, whatever the file's size. Files that only Spark's readers can open are hashed from their whole
    content, which Spark holds in memory (2 GB at most).
    """
    def read(wanted: str) -> DataFrame:
        return spark.read.format("binaryFile").option("pathGlobFilter", wanted).option("recursiveFileLookup", "true").load(folder)

    def hashed(tables):
        for t in tables:
            yield t.assign(sha256=[digest(p) for p in t["path"]])

    found = written(read(pattern).select("path", "length").mapInPandas(hashed, "path string, length long, sha256 string"), "digests")
    if not found.filter("sha256 IS NULL").head(1):
        return found
    rest = read(pattern).join(found.filter("sha256 IS NULL").select("path"), "path").select("path", "length", F.sha2("content", 256).alias("sha256"))
    return found.filter("sha256 IS NOT NULL").unionByName(rest)


def transfer_hypotheses(selected: DataFrame, extra: Mapping[str, str] | None = None) -> DataFrame:
    """Selected rows by (pattern, horizon) with the sorted structures they were found in."""
    g = selected.groupBy("hypothesis", "horizon").agg(F.sort_array(F.collect_set("structure_id")).alias("source_structures"))
    return g.withColumns({k: F.lit(v) for k, v in (extra or {}).items()})


def write_predictions(predictions: DataFrame, path: str) -> None:
    predictions.write.option("header", True).option("compression", "gzip").csv(path)


def pending(specs: DataFrame, done: DataFrame, contract: str) -> DataFrame:
    """Work not committed yet. Committed rows of another contract stop the job."""
    from candlemill.operators.checks import require_none

    require_none(done.filter(F.col("contract") != contract), "committed work follows another contract")
    return specs.join(done.select("run_id"), "run_id", "left_anti")


def freeze_choice(spark: SparkSession, choice: DataFrame, path: str) -> DataFrame:
    """Write a one-row choice once; a later, different choice is refused."""
    try:
        old = spark.read.json(path)
    except Exception as exc:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        choice.write.json(path)
        return choice
    same = [c for c in choice.columns]
    if choice.select(*[F.col(c).cast("string") for c in same]).exceptAll(old.select(*[F.col(c).cast("string") for c in same])).count():
        raise ValueError("a different choice was frozen before")
    return choice


def value_identity(bars: DataFrame) -> DataFrame:
    """Economic identity of each run from its values alone: names, labels and paths do not count."""
    from candlemill.operators.controls import price_prefixes

    p = price_prefixes(bars)
    return p.groupBy("run_id").agg(F.max_by("prefix", "bar_index").alias("economic_id"), F.count(F.lit(1)).alias("bars"))


def file_identity(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Identity of files from their bytes."""
    return file_digests(spark, folder, pattern).select(
        name_below(folder, F.col("path")).alias("file_name"), F.concat(F.lit("REAL-"), F.substring("sha256", 1, 20)).alias("dataset_id"))
