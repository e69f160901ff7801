"""A training-corpus pipeline of five stages, each written as Parquet and read again by the next.

1. quality: documents that the positive-unlabelled classifier rejects go.
2. near_duplicates: one document of each group at a similarity of 0.8 or more stays, the one with the smallest id.
3. decontamination: documents that leak a benchmark item go.
4. mixture: sources are brought to their target weights; a document is there as often as it was taken.
5. shards: rows are placed in 24 shards of near-equal bytes, with gapless slots.

No stage has SQL: the classifier is trained and the mixture draws by hash; they are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from candlemill.llm import decontam, kd_shards, mixing, near_dup, pu_quality
from candlemill.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = pu_quality.train(docs, _table(spark, sf_dir, "labels"))
    return docs.filter(pu_quality.score_column(model, docs["text"]) >= 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove_leaks(docs, _table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kd_shards.kd_shards(docs, 24)


STAGES = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("shards", shards),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last with ``size``, ``text_crc32``, ``shard`` and ``slot``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
