"""Fail-closed behaviour, file round trips and preparation by hand."""

import pytest
from pyspark.sql import functions as F

from candlemill.models import training as M
from candlemill.operators import checks as C, classification as K, dataset as D, grids as G
from candlemill.session import scratch_path
from candlemill.sinks import files as W
from candlemill.sources import files as R


def test_threshold_choice_fails_closed(spark):
    m = spark.createDataFrame([(0.5, 10, 4, 0.1)], "threshold double, selected_trades long, selected_runs long, mean_run_net_return_points double")
    with pytest.raises(ValueError):
        K.require_threshold(m, 25, 5)
    assert K.require_threshold(m, 5, 2) == 0.5


def test_threshold_ties_prefer_runs_then_lower_threshold(spark):
    rows = [(0.5, 30, 6, 0.1), (0.6, 30, 7, 0.1), (0.7, 30, 7, 0.1)]
    m = spark.createDataFrame(rows, "threshold double, selected_trades long, selected_runs long, mean_run_net_return_points double")
    assert K.require_threshold(m, 25, 5) == 0.6


def test_calibration_bin_edge(spark):
    df = spark.createDataFrame([(0.3,), (1.0,), (0.0,)], "p double").select(K.calibration_bin(F.col("p")).alias("b"))
    assert [r.b for r in df.collect()] == [2, 9, 0]


def test_one_class_has_no_ranking(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "label long, probability double")
    assert K.ranking_metrics(df).head().roc_auc is None


def test_leaked_outcome_is_refused(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "x double, exit_mid double")
    with pytest.raises(ValueError):
        M.guard(["x", "exit_mid"], df.columns)
    with pytest.raises(ValueError):
        M.guard(["x", "absent"], df.columns)


def test_preparation_moments_by_hand(spark):
    rows = [(1.0, "a", 0), (None, "b", 1), (3.0, None, 0), (5.0, "a", 1)]
    df = spark.createDataFrame(rows, "x double, c string, y int")
    p = M.fit_preparation(df, ["x"], ["c"])
    assert p.mean["x"] == 3.0 and p.scale["x"] == pytest.approx(2 ** 0.5)
    assert p.vocabulary["c"] == ["<MISSING>", "<UNKNOWN>", "a", "b"]
    new = spark.createDataFrame([(None, "z")], "x double, c string").select(*[v.alias(f"f{i}") for i, v in enumerate(p.columns().values())]).head()
    assert list(new) == [0.0, 1.0, 0.0, 1.0, 0.0, 0.0]


def test_vocabulary_cap(spark):
    df = spark.range(200).select(F.lit(1.0).alias("x"), F.concat(F.lit("c"), F.col("id")).alias("c"))
    assert len(M.fit_preparation(df, ["x"], ["c"], max_categories=8).vocabulary["c"]) == 8


def test_csv_header_rules(spark):
    def write(header, row):
        path = scratch_path(spark, "csv")
        spark.createDataFrame([(header,), (row,)], "value string").coalesce(1).write.text(path)
        return path

    ok = write("TimeStamp,Open,HIGH,low,Close", "2024-01-01T00:00:00Z,1,2,0.5,1.5")
    r = R.read_ohlcv(spark, ok).head()
    assert (r.entry_mid, r.exit_mid, r.entry_spread, r.volume) == (1.0, 1.5, 5e-4, 0.0)
    naive = R.read_ohlcv(spark, write("time,open,high,low,close", "2024-01-01 00:00:00,1,2,0.5,1.5"))
    assert C.bad_csv_rows(naive).count() == 1
    for header in ("time,open,high,low,close,bid,ask", "time,open,high,low,close,open_bid", "time,open,high,low"):
        with pytest.raises(ValueError):
            R.read_ohlcv(spark, write(header, "2024-01-01T00:00:00Z,1,2,0.5,1.5,1,1"))
    quoted = R.read_ohlcv(spark, write("time,open,high,low,close,open_bid,open_ask,close_bid,close_ask", "2024-01-01T00:00:00Z,90,120,80,110,89,91,108,112")).head()
    assert quoted.entry_mid == 90.0 and quoted.exit_spread == pytest.approx(4 / 110)


def test_files_are_read_by_their_own_header(spark):
    base = scratch_path(spark, "csv")
    for folder, lines in (("x", ["time,open,high,low,close", "2024-01-01T00:00:00Z,1,4,0.5,2"]), ("y", ["time,close,open,high,low", "2024-01-01T00:00:00Z,20,10,40,5"])):
        spark.createDataFrame([(v,) for v in lines], "value string").coalesce(1).write.text(f"{base}/{folder}")
    rows = sorted(tuple(r) for r in R.read_ohlcv(spark, f"{base}/*").select("open", "high", "low", "close").collect())
    assert rows == [(1.0, 4.0, 0.5, 2.0), (10.0, 40.0, 5.0, 20.0)]
    assert R.read_ohlcv(spark, f"{base}/*").select("run_id").distinct().count() == 2


def test_parts_of_a_split_add_up():
    for total in range(40):
        parts = D.split_counts(total)
        assert sum(parts.values()) == total and (total < 3 or min(parts.values()) >= 1)
    assert D.split_counts(10) == {"train": 6, "validation": 2, "test": 2}


def test_file_identity_is_of_the_bytes(spark, sf_dir):
    import hashlib

    got = {r.file_name: r.dataset_id for r in W.file_identity(spark, sf_dir, "*.parquet").collect()}
    want = "REAL-" + hashlib.sha256(open(f"{sf_dir}/nation.parquet", "rb").read()).hexdigest()[:20]
    assert got["nation.parquet"] == want and len(set(got.values())) == len(got)


def test_adjusted_columns(spark):
    path = scratch_path(spark, "csv")
    spark.createDataFrame([("date,adj_open,adj high,adj_low,adj_close",), ("2024-01-01T00:00:00+02:00,1,2,0.5,1.5",)], "value string").coalesce(1).write.text(path)
    r = R.read_ohlcv(spark, path, price_basis="adjusted").select(F.unix_seconds("ts").alias("t"), "high").head()
    assert r.t == 1704060000 and r.high == 2.0


def test_timeframe_labels():
    assert C.timeframe_seconds("15m") == 900 and C.timeframe_seconds("1w") == 604800
    for bad in ("1mo", "m", "0h", "-1d"):
        with pytest.raises(ValueError):
            C.timeframe_seconds(bad)


def test_frozen_choice_cannot_change(spark):
    path = scratch_path(spark, "choice")
    a = spark.createDataFrame([("m1", 0.5)], "model string, threshold double")
    W.freeze_choice(spark, a, path)
    W.freeze_choice(spark, a, path)
    with pytest.raises(ValueError):
        W.freeze_choice(spark, spark.createDataFrame([("m2", 0.5)], "model string, threshold double"), path)


def test_resume_refuses_another_contract(spark):
    specs = spark.createDataFrame([("r1",), ("r2",)], "run_id string")
    done = spark.createDataFrame([("r1", "c1")], "run_id string, contract string")
    assert [r.run_id for r in W.pending(specs, done, "c1").collect()] == ["r2"]
    with pytest.raises(ValueError):
        W.pending(specs, done, "c2")


def test_split_ignores_row_order_and_outcomes(spark):
    u = spark.createDataFrame([(f"r{i}", f"s{i // 2}", "structured") for i in range(20)], "run_id string, structure_id string, world_family string")
    a = {r.structure_id: r.split for r in D.assign_splits(u).collect()}
    b = {r.structure_id: r.split for r in D.assign_splits(u.orderBy(F.desc("run_id"))).collect()}
    assert a == b
    assert sorted(a.values()).count("train") == 6


def test_overlapping_overrides_are_refused():
    with pytest.raises(ValueError):
        G.override(None, {"a": None, "a.b": None})


def test_prefix_ignores_names(spark):
    rows = [("a", 0, 1.0), ("a", 1, 1.1), ("b", 0, 1.0), ("b", 1, 1.2)]
    bars = spark.createDataFrame(rows, "run_id string, bar_index long, close double").withColumns(
        {c: F.col("close") for c in ("open", "high", "low")} | {"volume": F.lit(1)})
    ids = {r.run_id: r.economic_id for r in W.value_identity(bars.filter("bar_index = 0")).collect()}
    assert ids["a"] == ids["b"]
    ids = {r.run_id: r.economic_id for r in W.value_identity(bars).collect()}
    assert ids["a"] != ids["b"]
