"""Spelling variants of words by a relational trie frontier.

Words stand in a trie whose branches are rows (node, first character, label, child). States (word, position, node, edits)
walk it level by level: a state joins the branches of its node and moves along those whose label goes on with its word,
unchanged or with the one edit. A state that used its edit and has read its whole word at the end of another word makes
the two neighbours.

The branches of a level come from the same walk: the unedited states at a node are the words below it, and the common
beginning of the least and the greatest word behind a first character is that branch's label. So a level is a few
aggregates and joins, and the number of levels is that of branchings on a path, not the length of the longest word. They go
one level ahead of the edited ones, which therefore stay only where their next character leads on.

The trie of the words holds edits in the second half of a word, the trie of the reversed words those in the first half: an edit
is tried only where half of the word has matched, where few branches are left.
"""

from __future__ import annotations

import os.path

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType

from candlemill.llm.columns import lower_ascii
from candlemill.session import scratch_path
from candlemill.sources.series import written

RUN = "[A-Za-zÀ-ÿ]+"
FEW_BRANCHES, FEW_BYTES = 50_000, 2 << 20  # a level with fewer branches is broadcast
HOT_SHARE = 256  # a node with more than this share of the states is joined by broadcast: at most so many nodes


def corpus_words(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shortest: int = 5, least: int = 3, spoil: int = 97) -> DataFrame:
    """``word``, ``n``: the words of whole texts with at least ``shortest`` characters and ``least`` occurrences.

    A word is a maximal run of letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. Where ``spoil`` divides the crc32 h of
    "id:word", the character h mod length is deleted first. A null id is the empty text there; null and empty texts hold no
    words; repeated rows count again.
    """
    runs = F.regexp_extract_all(lower_ascii(F.col(text)), F.lit(f"({RUN})"), 1)
    each = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    spoiled = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    words = each.select(F.when(h % spoil == 0, spoiled).otherwise(F.col("run")).alias("word"))
    return words.filter(F.char_length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


@F.pandas_udf(IntegerType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Characters with which both begin."""
    return pd.Series([len(os.path.commonprefix(p)) for p in zip(a, b)], dtype="int32")


def _from(text: Column, start: Column) -> Column:
    return text.substr(start + 1, F.char_length(text))


def _branches(states: DataFrame) -> DataFrame:
    """Branches of the nodes at which the unedited ``states`` stand: ``way``, ``node``, ``first``, ``label``, ``ends``, ``leaf``.

    ``ends`` is the count of the word that ends where the branch does, null if none does; behind a leaf there is no other word.
    """
    below = states.filter("at < length").groupBy("way", "node", F.col("word").substr(F.col("at") + 1, F.lit(1)).alias("first"))
    spans = below.agg(F.min(F.struct("word", "n")).alias("least"), F.max("word").alias("last"))
    spans = spans.withColumn("stop", _common(F.col("least.word"), F.col("last")))
    child = F.col("least.word").substr(F.lit(1), F.col("stop"))
    return spans.select(
        "way", "node", "first", _from(child, F.char_length("node")).alias("label"),
        F.when(F.col("least.word") == child, F.col("least.n")).alias("ends"), (F.col("least.word") == F.col("last")).alias("leaf"))


def _met(states: DataFrame, branches: DataFrame, hot: DataFrame | None, keys: list[str]) -> DataFrame:
    """States beside the branches with equal ``keys``. Without ``hot`` the branches are few and broadcast; else those of the
    nodes that many states share are, which are few too."""
    if hot is None:
        return states.join(F.broadcast(branches), keys)
    few = F.broadcast(branches.join(F.broadcast(hot), ["way", "node"], "left_semi"))
    cold = states.join(F.broadcast(hot), ["way", "node"], "left_anti").join(branches, keys)
    return states.join(few, keys).select(*cold.columns).unionByName(cold)


_STATE = ("way", "word", "length", "at", "node")


def _first(states: DataFrame) -> DataFrame:
    return states.withColumn("first", F.col("word").substr(F.col("at") + 1, F.lit(1)))


def _rest() -> Column:
    return _from(F.col("word"), F.col("at"))


def _on(states: DataFrame, branches: DataFrame, hot: DataFrame | None, *more: str) -> DataFrame:
    """States behind the branch that goes on as their word does."""
    met = _met(_first(states.filter("at < length")), branches, hot, ["way", "node", "first"])
    k = F.char_length("label")
    met = met.filter(_rest().substr(F.lit(1), k) == F.col("label"))
    return met.select("way", "word", "length", (F.col("at") + k).alias("at"), F.concat("node", "label").alias("node"), "ends", *more)


def _edited(states: DataFrame, branches: DataFrame, hot: DataFrame | None) -> DataFrame:
    """States behind every other branch after one edit, where half of the word has matched."""
    ready = _first(states.filter("at >= open")).withColumnRenamed("first", "next")
    other = _met(ready, branches, hot, ["way", "node"]).filter("first != next")
    k, rest, tail = F.char_length("label"), _rest(), _from(F.col("label"), F.lit(1))
    read = F.array_compact(F.array(
        F.when((F.col("next") != "") & (rest.substr(F.lit(2), k - 1) == tail), k),  # replaced
        F.when(rest.substr(F.lit(1), k - 1) == tail, k - 1),  # inserted
        F.when(rest.substr(F.lit(2), k) == F.col("label"), k + 1)))  # deleted
    return other.withColumn("read", F.explode(read)).select(
        "way", "word", "length", (F.col("at") + F.col("read")).alias("at"), F.concat("node", "label").alias("node"), "ends", "nexts")


def _looking_ahead(branches: DataFrame, further: DataFrame) -> DataFrame:
    """``branches`` with ``nexts``, the first characters of the branches behind each; empty behind a leaf."""
    behind = further.groupBy("way", "node").agg(F.concat_ws("", F.collect_list("first")).alias("nexts"))  # one entry per letter
    child = F.concat("b.node", "b.label")
    met = branches.alias("b").join(behind.alias("f"), (F.col("b.way") == F.col("f.way")) & (child == F.col("f.node")), "left")
    return met.select("b.*", F.coalesce("f.nexts", F.lit("")).alias("nexts"))


def near_words(words: DataFrame) -> DataFrame:
    """``word``, ``near``, ``near_n``: all ordered pairs of words that differ by one inserted, deleted or replaced character.

    ``words`` holds distinct, non-empty ``word`` with counts ``n``.
    """
    spark = words.sparkSession
    length = F.char_length("word")
    half = F.floor(length / 2).cast("int")
    start = words.select(F.explode(F.array(
        F.struct(F.lit(0).alias("way"), F.col("word"), half.alias("open")), F.struct(F.lit(1).alias("way"), F.reverse("word").alias("word"), (length - half).alias("open")))).alias("s"), "n")
    plain = written(start.select("s.way", "s.word", F.char_length("s.word").alias("length"), F.lit(0).alias("at"), F.lit("").alias("node"), "n", "s.open"), "trie-plain")
    branches = written(_branches(plain), "trie-branches")
    used = plain.select(*_STATE).filter("false")
    plain_paths: list[str] = []
    used_paths: list[str] = []
    n_plain, n_used = plain.count(), 0
    while n_plain or n_used:
        n_branches, size = branches.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("label") + F.octet_length("node")), F.lit(0))).head()
        hot = None
        if n_branches > FEW_BRANCHES or size > FEW_BYTES:
            count = plain.select("way", "node").unionByName(used.select("way", "node")).groupBy("way", "node").count()
            hot = written(count.filter(F.col("count") > (n_plain + n_used) / HOT_SHARE).select("way", "node"), "trie-hot")
        plain_paths.append(scratch_path(spark, "trie-plain"))
        _on(plain, branches.filter("NOT leaf"), hot, "n", "open").write.parquet(plain_paths[-1])
        further = spark.read.parquet(plain_paths[-1])
        below = written(_branches(further), "trie-branches")
        seen = written(_looking_ahead(branches, below), "trie-seen")
        moved = _on(used, seen, hot, "nexts").unionByName(_edited(plain, seen, hot))
        # a word read to its end must end there; another must find its next character
        alive = F.when(F.col("at") == F.col("length"), F.col("ends").isNotNull()).otherwise(F.instr("nexts", F.col("word").substr(F.col("at") + 1, F.lit(1))) > 0)
        used_paths.append(scratch_path(spark, "trie-used"))
        moved.filter(alive).drop("nexts").write.parquet(used_paths[-1])
        plain, branches = further.drop("ends"), below
        used = spark.read.parquet(used_paths[-1]).filter("at < length").drop("ends")
        n_plain, n_used = plain.count(), used.count()
    if not plain_paths:
        return words.select("word", F.col("word").alias("near"), F.col("n").alias("near_n")).filter("false")
    # the whole word read where another ends; or all but its last character, unedited
    found = spark.read.parquet(*used_paths).filter("at = length").select("way", "word", "node", "ends").unionByName(
        spark.read.parquet(*plain_paths).filter("ends IS NOT NULL AND at = length - 1 AND at >= open").select("way", "word", "node", "ends"))

    def forward(name: str) -> Column:
        return F.when(F.col("way") == 1, F.reverse(name)).otherwise(F.col(name)).alias(name)

    found = found.select("way", "word", F.col("node").alias("near"), F.col("ends").alias("near_n"))
    return found.select(forward("word"), forward("near"), "near_n").distinct()


def _roots(links: DataFrame) -> DataFrame:
    """``word``, ``root``: where the forms of each word end. Every round doubles the steps followed."""
    now = written(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "trie-roots")
    while now.filter("moved").head(1):
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = written(now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "trie-roots")
    return now.select("word", "root")


def variant_forms(words: DataFrame, *, times: int = 2) -> DataFrame:
    """Per word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    A word's form is its near word of largest count (ties: the smallest), if that is at least ``times`` the word's own; its root
    is where the forms end. Words without near words have ``n_near`` 0. No words give no rows. Null and empty words are left
    out; repeated words count together; other columns are not looked at.
    """
    own = written(words.select("word", "n").filter("word != ''").groupBy("word").agg(F.sum("n").alias("n")), "trie-words")
    best = near_words(own).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    fits = -F.col("best.n") >= times * F.col("n")
    formed = own.join(best, "word", "left").select(
        "word", F.when(fits, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, -F.col("best.n")).alias("form_n"))
    formed = written(formed, "trie-forms")
    roots = _roots(formed.filter("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
