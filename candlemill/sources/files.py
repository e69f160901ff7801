"""File sources: OHLCV and candle CSV, manifests, grids and labelled datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from candlemill.operators.checks import duplicate_keys, require_none
from candlemill.sources.series import number_series

QUOTES = ("open_bid", "open_ask", "close_bid", "close_ask")
TIMES = ("timestamp", "datetime", "date", "time")


def resolve_column(columns: Sequence[str], wanted: Sequence[str], required: bool = True) -> str | None:
    """Header name for one of ``wanted``, ignoring case, outer blanks and a byte-order mark."""
    known: dict[str, str] = {}
    for c in columns:
        key = c.lstrip("﻿").strip().lower()
        if key in known:
            raise ValueError(f"header repeats {key!r}")
        known[key] = c
    for w in wanted:
        if w.lower() in known:
            return known[w.lower()]
    if required:
        raise ValueError(f"no column named any of {list(wanted)}")
    return None


def _raw(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _number(name: str) -> Column:
    return F.trim(_raw(name)).try_cast("double")


def file_key(path: Column) -> Column:
    """One spelling of a file's full path: the key of a file wherever it is named, read or declared."""
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("%20"), F.lit(" ")), "^file:/+", "file:/"), r"/(\./)+", "/")


def declared_key(path: Column, manifest: Column) -> Column:
    """Key of a declared file: full paths as they are, others in the store or the folder of the manifest that declares them."""
    folder = F.regexp_replace(manifest, "[^/]*$", "")
    store = F.regexp_extract(manifest, "^([A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)", 1)
    return file_key(F.when(path.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), path).when(path.startswith("/"), F.concat(store, path)).otherwise(F.concat(folder, path)))


def read_ohlcv(
    spark: SparkSession, path: str, *, price_basis: str = "raw", fallback_spread_bps: float = 5.0,
    run_column: str | None = None,
) -> DataFrame:
    """OHLCV bars of many files at once, with execution columns. One run per file (its full path), or
    per value of ``run_column``. Files are read by their own header: one scan per distinct header.

    Unreadable values become NULL and are found by ``checks.bad_csv_rows``. Quotes need all four
    open/close bid/ask columns; plain bid/ask is refused because its time is unknown. Without
    quotes, open and close are the mids and the frozen spread applies.
    """
    if price_basis not in ("raw", "adjusted"):
        raise ValueError("price_basis must be raw or adjusted")
    if not 0 <= fallback_spread_bps < 20_000:
        raise ValueError("fallback_spread_bps must lie in [0, 20000)")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    # the header is the first line of a file's first block; distinct headers are few
    first = lines.filter("start = 0").withColumn("at", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("value", "at").alias("header"))
    headers = first.groupBy("header").agg(F.collect_list("file").alias("files")).orderBy("header").collect()
    if not headers:
        raise ValueError(f"no file under {path}")
    out = None
    for h in headers:
        one = _one_header(spark, h["files"], price_basis, fallback_spread_bps, run_column)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def _one_header(spark: SparkSession, files: list[str], price_basis: str, fallback_spread_bps: float, run_column: str | None) -> DataFrame:
    reader = spark.read.option("header", True).option("inferSchema", False).option("encoding", "UTF-8").option("enforceSchema", False)
    raw = reader.csv(files)
    names = raw.columns
    pick = lambda n: resolve_column(names, (n,) if price_basis == "raw" else (f"adj_{n}", f"adj {n}"))
    ohlc = {n: pick(n) for n in ("open", "high", "low", "close")}
    if any(resolve_column(names, (n,), False) for n in ("bid", "ask")):
        raise ValueError("bid/ask without a time: use open_bid, open_ask, close_bid, close_ask")
    quotes = {n: resolve_column(names, (n,), False) for n in QUOTES}
    if any(quotes.values()) and not all(quotes.values()):
        raise ValueError("execution quotes need all four open/close bid/ask columns")
    volume = resolve_column(names, ("volume",), False)
    time = F.trim(_raw(resolve_column(names, TIMES)))
    # Only texts with a zone are times; everything else becomes NULL.
    zoned = time.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")
    columns = [
        (_raw(run_column) if run_column else file_key(F.col("_metadata.file_path"))).alias("run_id"),
        F.when(zoned, time.try_cast("timestamp")).alias("ts"),
        *[_number(c).alias(n) for n, c in ohlc.items()],
        (_number(volume) if volume else F.lit(0.0)).alias("volume"),
    ]
    have = all(quotes.values())
    if have:
        columns += [_number(c).alias(n) for n, c in quotes.items()]
    return with_quotes(raw.select(*columns), fallback_spread_bps)


def with_quotes(bars: DataFrame, fallback_spread_bps: float = 5.0) -> DataFrame:
    """entry/exit mid and spread from explicit quotes, else from open/close and a constant spread."""
    if set(QUOTES) <= set(bars.columns):
        mid = lambda side: F.col(f"{side}_bid") / 2 + F.col(f"{side}_ask") / 2
        cols = {}
        for out, side in (("entry", "open"), ("exit", "close")):
            cols[f"{out}_mid"] = mid(side)
            cols[f"{out}_spread"] = F.try_divide(F.col(f"{side}_ask") - F.col(f"{side}_bid"), mid(side))
        return bars.withColumns(cols).withColumn("execution_source", F.lit("explicit_open_close_quotes"))
    spread = F.lit(fallback_spread_bps / 1e4)
    return bars.withColumns({
        "entry_mid": F.col("open"), "exit_mid": F.col("close"), "entry_spread": spread, "exit_spread": spread,
        "execution_source": F.lit("modeled_ohlc_mid_with_frozen_spread"),
    })


def indexed_bars(bars: DataFrame) -> DataFrame:
    """Number the bars of every file in time order."""
    return number_series(bars, "run_id", ["ts"], step="bar_index")


CANDLES = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("candle_number", T.LongType()),
    T.StructField("start_step", T.LongType()), T.StructField("end_step", T.LongType()),
    T.StructField("open", T.DoubleType()), T.StructField("high", T.DoubleType()), T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()), T.StructField("volume", T.LongType()), T.StructField("is_complete", T.StringType()),
])


def read_candles(spark: SparkSession, path: str) -> DataFrame:
    """Detector-ready candle CSV; completeness may be written as true/false or 1/0."""
    raw = spark.read.schema(CANDLES).option("header", True).option("enforceSchema", False).csv(path)
    done = F.lower(F.trim("is_complete")).isin("true", "1")
    return raw.withColumn("is_complete", done).withColumn("bar_index", F.col("candle_number") - 1)


SPEC = T.StructType([T.StructField(n, T.StringType()) for n in (
    "path", "asset", "venue", "timeframe", "price_basis", "corporate_action_policy", "session_policy", "timestamp_semantics", "dependence_group")])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Dataset declarations of manifest files, with policy defaults. ``run_id`` is the declared file's full path, as
    ``read_ohlcv`` names its runs: equal base names in two folders stay apart."""
    shape = T.StructType([T.StructField("datasets", T.ArrayType(SPEC))])
    read = spark.read.schema(shape).option("multiLine", True).json(path)
    d = read.select(F.col("_metadata.file_path").alias("_manifest"), F.explode("datasets").alias("d")).select("_manifest", "d.*")
    return d.withColumn("run_id", declared_key(F.col("path"), F.col("_manifest"))).drop("_manifest").withColumns({
        "session_policy": F.coalesce("session_policy", F.lit("continuous")),
        "timestamp_semantics": F.coalesce("timestamp_semantics", F.lit("bar_open")),
    })


def manifest_mismatch(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Files without a declaration, declarations without a file, and repeated declarations."""
    m, f = manifest.select("run_id"), files.select("run_id").distinct()
    side = lambda df, text: df.withColumn("problem", F.lit(text))
    return (
        side(f.join(m, "run_id", "left_anti"), "undeclared file")
        .unionByName(side(m.distinct().join(f, "run_id", "left_anti"), "declared file is missing"))
        .unionByName(side(duplicate_keys(m, ["run_id"]).select("run_id"), "declared twice"))
    )


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """Parameter grid file: dotted path -> non-empty array; one row per value."""
    text = spark.read.text(path, wholetext=True)
    grid = F.from_json("value", T.MapType(T.StringType(), T.ArrayType(T.StringType())))
    x = text.select(F.explode(grid).alias("path", "values"))
    require_none(x.filter(F.coalesce(F.size("values"), F.lit(0)) == 0), "empty value list in the grid")
    return x.select("path", F.posexplode("values").alias("position", "value"))


def read_labelled(spark: SparkSession, path: str, split: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Labelled dataset on a split-partitioned layout; a split filter prunes folders, a column list
    prunes the scan. Unknown columns and an empty dataset are refused."""
    df = spark.read.parquet(path)
    missing = [c for c in columns or () if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns: {missing}")
    if split is not None:
        df = df.filter(F.col("split") == split)
    df = df.select(*columns) if columns else df
    if df.isEmpty():
        raise ValueError("the dataset holds no rows")
    return df


def read_runs(runs: DataFrame, rows: DataFrame, split: str | None = None) -> DataFrame:
    """Every run with its rows; runs without rows stay, once, with NULLs."""
    base = runs if split is None else runs.filter(F.col("split") == split)
    return base.join(rows.drop(*[c for c in rows.columns if c in base.columns and c != "run_id"]), "run_id", "left")


def read_frozen_manifest(spark: SparkSession, path: str, expected: dict) -> DataFrame:
    """Frozen one-row manifest; differing contract keys stop the load before anything is used."""
    from candlemill.operators.checks import contract_differences

    m = spark.read.json(path)
    require_none(contract_differences(m, expected), "frozen manifest differs")
    return m
