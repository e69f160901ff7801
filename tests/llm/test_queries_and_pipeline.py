"""Registered queries against their SQL, and the pipeline's stages against what they promise."""

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from candlemill.catalog.compare import check, oracle
from candlemill.llm import decontam
from candlemill.llm.queries import QUERIES, SQL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, sf_dir):
    ok, message = check(name, QUERIES[name], SQL.get(name), spark, oracle(sf_dir), sf_dir)
    assert ok, message


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).persist()
        kept[name] = [r.asDict() for r in docs.collect()]
        if name != "shards":
            assert docs.columns == columns
    good = {r["doc_id"] for r in kept["quality"]}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert sum(labels[i] for i in good if i in labels) >= 0.97 * sum(labels.values())

    def shingles(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {r["doc_id"]: shingles(r["text"]) for r in kept["quality"]}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert sorted(r["doc_id"] for r in kept["near_duplicates"]) == [i for i in ids if find(i) == i]
    frame = spark.createDataFrame([(r["doc_id"], r["text"]) for r in kept["near_duplicates"]], "doc_id long, text string")
    leaks = {r.doc_id for r in decontam.find_leaks(frame, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert sorted(r["doc_id"] for r in kept["decontamination"]) == sorted(r["doc_id"] for r in kept["near_duplicates"] if r["doc_id"] not in leaks)
    copies = Counter(r["doc_id"] for r in kept["mixture"])
    assert set(copies) <= {r["doc_id"] for r in kept["decontamination"]} and max(copies.values()) <= 2
    assert Counter(r["doc_id"] for r in kept["shards"]) == copies
    assert all(r["text_crc32"] == zlib.crc32(r["text"].encode()) for r in kept["shards"])
    assert {r["shard"] for r in kept["shards"]} == set(range(24))


def test_pipeline_takes_odd_rows(spark, sf_dir):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "a b c d e f", "en", "s", 11), (3, "a b c d e f", None, "t", None)],
                                "doc_id long, text string, lang string, source string, n_chars long")
    odd = odd.withColumns({"_th": F.lit("mine"), "size": F.lit("mine"), "_copy": F.lit("mine")})
    for name, stage in corpus_pipeline.STAGES:
        told = stage(spark, odd, sf_dir)
        rows, given = Counter((r.doc_id, r.text) for r in told.collect()), Counter((r.doc_id, r.text) for r in odd.collect())
        assert set(rows) <= set(given)
        if name == "near_duplicates":  # one of the two equal texts; wordless rows all stay
            assert rows == given - Counter({(3, "a b c d e f"): 1})
        if name == "decontamination":
            assert rows == given
        if name == "mixture":  # only rows with words are taken
            assert set(rows) == {(2, "a b c d e f"), (3, "a b c d e f")} and max(rows.values()) <= 2
        if name == "shards":
            assert rows == given
        else:
            assert told.columns == odd.columns
            assert {(r["_th"], r["size"], r["_copy"]) for r in told.collect()} <= {("mine",) * 3}
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
    assert empty.agg(F.count(F.lit(1))).head()[0] == 0
