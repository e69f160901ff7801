"""Declared price files end to end: one key from file to manifest, guards, clusters, pooled hypotheses."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlemill.config import PatternConfig, ProcedureConfig
from candlemill.plans.real_data import declared_bars, real_data_validation
from candlemill.session import scratch_path
from candlemill.sources import files as R

SMALL = ProcedureConfig(horizons=(5,))


def write_lines(spark, path, lines):
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(path)


def rename_parts(spark, folder, name):
    """Spark names its part files; a dataset has a name of its own."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    part = [f.getPath() for f in fs.listStatus(hadoop.Path(folder)) if f.getPath().getName().startswith("part-")][0]
    fs.rename(part, hadoop.Path(f"{folder}/{name}"))


def site(spark, declared, starts=(0, 10_000_000, 2_000)):
    """Three files, two of one base name in two folders with their columns in another order."""
    base = scratch_path(spark, "real")
    rng = np.random.default_rng(3)
    for k, (folder, name, start) in enumerate((("a", "btc.csv", starts[0]), ("b", "btc.csv", starts[1]), ("b2", "eth.csv", starts[2]))):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 420)))
        opened = np.concatenate([[100.0], close[:-1]])
        high, low = np.maximum(opened, close) * 1.002, np.minimum(opened, close) * 0.998
        times = [f"{np.datetime64('2020-01-01T00:00:00') + np.timedelta64(int(start + 3600 * i), 's')}Z" for i in range(420)]
        if k == 1:
            lines = ["close,volume,time,low,high,open"] + [f"{c},{5},{t},{lo},{h},{o}" for t, o, h, lo, c in zip(times, opened, high, low, close)]
        else:
            lines = ["time,open,high,low,close,volume"] + [f"{t},{o},{h},{lo},{c},{5}" for t, o, h, lo, c in zip(times, opened, high, low, close)]
        write_lines(spark, f"{base}/{folder}", lines)
        rename_parts(spark, f"{base}/{folder}", name)
    write_lines(spark, f"{base}/manifest", [json.dumps({"datasets": declared(base)})])
    rename_parts(spark, f"{base}/manifest", "manifest.json")
    return f"{base}/manifest/manifest.json", f"{base}/[ab]*"


def spec(path, asset, **more):
    return {"path": path, "asset": asset, "venue": "x", "timeframe": "1h", "price_basis": "raw", "corporate_action_policy": "none_in_window"} | more


def three(base):
    """A full path, one with its scheme, and one beside the manifest."""
    return [spec(f"{base}/a/btc.csv", "BTC"), spec(f"file://{base}/b/btc.csv", "BTC"), spec("./../b2/eth.csv".replace("./../", f"{base}/./"), "ETH")]


def test_one_key_from_file_to_manifest(spark):
    manifest, csv = site(spark, three)
    declared, bars = declared_bars(spark, manifest, csv)
    assert R.manifest_mismatch(declared, bars).collect() == []
    assert bars.select("run_id").distinct().count() == 3 and bars.count() == 3 * 420
    first = {r.run_id.rsplit("/", 2)[1]: (r.open, r.close) for r in bars.filter("bar_index = 0").collect()}
    assert all(o == 100.0 and c != 100.0 for o, c in first.values()) and set(first) == {"a", "b", "b2"}




@pytest.mark.parametrize("path, manifest, key", [
    ("x.csv", "file:///data/m.json", "file:/data/x.csv"), ("./s/x.csv", "file:///data/m.json", "file:/data/s/x.csv"), ("/abs/x.csv", "file:///data/m.json", "file:/abs/x.csv"),
    ("/abs/x.csv", "hdfs://nn:8020/data/m.json", "hdfs://nn:8020/abs/x.csv"), ("s3a://other/x.csv", "hdfs://nn/data/m.json", "s3a://other/x.csv"), ("a b.csv", "file:///my%20data/m.json", "file:/my data/a b.csv"),
])
def test_declared_keys(spark, path, manifest, key):
    assert spark.range(1).select(R.declared_key(F.lit(path), F.lit(manifest))).head()[0] == key


def test_undeclared_and_missing_files_stop_the_load(spark):
    manifest, csv = site(spark, lambda base: three(base)[:2] + [spec("none.csv", "ETH")])
    with pytest.raises(ValueError, match="files and declarations differ"):
        declared_bars(spark, manifest, csv)


def test_datasets_of_one_asset_may_not_overlap(spark):
    manifest, csv = site(spark, three, starts=(0, 3600 * 10, 0))
    with pytest.raises(ValueError, match="overlap"):
        real_data_validation(spark, manifest, csv, config=PatternConfig(core_lengths=(35,)), procedure=SMALL)


def test_validation_of_declared_files(spark):
    manifest, csv = site(spark, three)
    out = real_data_validation(spark, manifest, csv, config=PatternConfig(core_lengths=(35,)), procedure=SMALL)
    cluster = {r.dataset_id.rsplit("/", 2)[1]: r.cluster_id for r in out["dependence"].collect()}
    assert cluster["a"] == cluster["b2"] != cluster["b"]
    assert out["metrics"].select("run_id").distinct().count() == 3
    pooled = out["pooled"].collect()
    assert len(pooled) == out["metrics"].select("hypothesis", "horizon").distinct().count()
    total = out["metrics"].groupBy("hypothesis").agg(F.sum("event_count").alias("n")).collect()
    assert {r.hypothesis: r.event_count for r in pooled} == {r.hypothesis: r.n for r in total} and sum(r.n for r in total) > 0
    assert all(r.seed_count_total == 2 for r in pooled)
