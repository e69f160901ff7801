"""URL filter: rules first, then segmented host words scored by multinomial naive Bayes.

A name such as ``cheappills`` is split into words by a unigram Viterbi search: every substring of a distinct name is
joined with the table of word counts (no dictionary is broadcast), and the best path over the matches is taken per
name. Host words and path tokens of the urls then train and apply a multinomial naive Bayes model whose classes come
from a stated list of seed words: a url with a seed among its host words is an example of ``block``, any other of
``allow``. All counting is partial aggregation; urls are grouped to (host, path tokens) shapes before tokens are spread.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from candlemill.llm.columns import lower_ascii, pack, unpack
from candlemill.sources.series import written

LONGEST = 24
# Seed words of the class ``block``.
SEEDS = (
    "adult", "ads", "bet", "bets", "betting", "bingo", "casino", "cheap", "dating", "escort", "farm", "free", "gambling", "jackpot", "loan", "loans",
    "lottery", "pharmacy", "pill", "pills", "poker", "porn", "replica", "sex", "slots", "spam", "track", "tracker", "viagra", "win", "xxx",
)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): what follows the first ``://``; both empty for null or without it."""
    whole = "(?s)^.*?://([^/?#]*)([^?#]*)"
    filled = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(filled, whole, 1)), F.regexp_extract(filled, whole, 2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, or null. Rules are a short list of settings."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def _pieces(text: Column) -> Column:
    """Runs of letters; a run of digits becomes ``0``."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), "[0-9]+", " 0 "), F.lit(r"(\p{L}+|0)"), 1)


def word_counts(texts: DataFrame) -> DataFrame:
    """``word``, ``n`` over the visible words of one column of (HTML) texts."""
    seen = F.regexp_replace(F.lower(F.coalesce(F.col(texts.columns[0]), F.lit(""))), "<[^>]*>", " ")
    return texts.select(F.explode(F.regexp_extract_all(seen, F.lit(r"\p{L}+"), 0)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _segmenter(total: float):
    def best(names: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for name, matches in zip(names, found):
            cost = {}
            for m in matches if matches is not None else ():
                cost[m["start"], m["size"]] = -math.log(m["n"] / total)
            top, back = [0.0] + [math.inf] * len(name), [0] * (len(name) + 1)
            for end in range(1, len(name) + 1):
                for size in range(1, min(LONGEST, end) + 1):
                    # an unknown word: ten times rarer with each letter
                    c = top[end - size] + cost.get((end - size, size), math.log(total) + (size - 1) * math.log(10.0) + 2.0)
                    if c < top[end]:
                        top[end], back[end] = c, size
            words, end = [], len(name)
            while end:
                words.append(name[end - back[end] : end])
                end -= back[end]
            out.append(words[::-1])
        return pd.Series(out)

    return best


def segment(names: DataFrame, counts: DataFrame) -> DataFrame:
    """``name``, ``words`` for a table of distinct ``name``; ``counts`` has ``word``, ``n``.

    The cost of a word is -log of its share; a word that was never seen costs ten times more with each letter.
    Of equally good splits the one with the shorter last word wins. Words are at most ``LONGEST`` letters.
    """
    total = float(counts.agg(F.sum("n")).head()[0] or 1)
    spans = names.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("at")).select(
        "name", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("name") - F.col("at") + 1))).alias("size"))
    spans = spans.withColumn("word", F.expr("substring(name, at, size)"))
    met = spans.join(counts, "word").groupBy("name").agg(F.collect_list(F.struct((F.col("at") - 1).alias("start"), "size", "n")).alias("found"))
    best = F.pandas_udf(_segmenter(total), "array<string>")
    return names.join(met, "name", "left").select("name", best("name", "found").alias("words"))


def judge_urls(
    pages: DataFrame, *, url: str = "url", texts: DataFrame | None = None, rules: Sequence[tuple[str, str]] = RULES, seeds: Sequence[str] = SEEDS,
) -> DataFrame:
    """All rows of ``pages`` with ``host``, ``path``, ``rule``, ``verdict``, ``host_words`` and ``block_odds``.

    ``texts`` (one text column) teaches word counts beside the urls' own pieces and the seeds. A null url, or one
    without ``://``, has an empty host and path, no words, and the verdict of the class priors. Columns of these
    names are replaced. Repeated rows are judged alike. Very long hosts cost in proportion to their length.
    """
    host, path = split_url(F.col(url))
    base = pack(pages, host=host, path=path).withColumn("by", rule_of(F.col("host"), F.col("path"), rules)).withColumn("tokens", _pieces(F.col("path")))
    shapes = written(base.groupBy("host", "tokens").agg(F.count(F.lit(1)).alias("n")), "url-shapes")
    hosts = shapes.groupBy("host").agg(F.sum("n").alias("n"))
    parts = hosts.select("host", "n", F.posexplode(_pieces(F.col("host"))).alias("at", "name"))
    # Words of the urls: what hyphens set apart in hosts, and path tokens. An unhyphenated label is no word of its own.
    apart = hosts.select(F.explode(F.split("host", r"\.")).alias("label")).filter(F.contains(F.col("label"), F.lit("-")))
    known = apart.select(F.explode(_pieces(F.col("label"))).alias("word")).unionByName(shapes.select(F.explode("tokens").alias("word")))
    known = known.unionByName(pages.sparkSession.createDataFrame([(s,) for s in seeds], "word string")).distinct().withColumn("n", F.lit(1).cast("long"))
    if texts is not None:
        known = known.unionByName(word_counts(texts)).groupBy("word").agg(F.sum("n").alias("n"))
    known = written(known, "url-words")
    names = parts.select("name").distinct()
    split = segment(names, known)
    words = parts.join(split, "name").groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("host_words"))
    told = shapes.join(words, "host", "left").withColumn("host_words", F.coalesce("host_words", F.array().cast("array<string>")))
    told = told.withColumn("block", F.arrays_overlap("host_words", F.array(*[F.lit(s) for s in seeds])).cast("double"))
    told = told.withColumn("all", F.concat(F.transform("host_words", lambda w: F.concat(F.lit("h:"), w)), F.transform("tokens", lambda w: F.concat(F.lit("p:"), w))))
    told = written(told.withColumn("shape", F.xxhash64("host", "tokens")), "url-words-of-shapes")
    sizes = told.agg(F.sum(F.col("n") * F.col("block")).alias("b"), F.sum(F.col("n") * (1 - F.col("block"))).alias("a")).head()
    spread = told.select("host", "tokens", "n", "block", F.explode("all").alias("token"))
    seen = spread.groupBy("token").agg(F.sum(F.col("n") * F.col("block")).alias("b"), F.sum(F.col("n") * (1 - F.col("block"))).alias("a"))
    seen = written(seen, "url-token-counts")
    sums = seen.agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.count(F.lit(1)).alias("v")).head()
    v = float(max(sums["v"], 1))
    odds = F.log((F.col("b") + 1) / F.lit((sums["b"] or 0.0) + v)) - F.log((F.col("a") + 1) / F.lit((sums["a"] or 0.0) + v))
    prior = math.log(((sizes["b"] or 0.0) + 1) / ((sizes["a"] or 0.0) + 1))
    scored = spread.join(seen.select("token", odds.alias("w")), "token").groupBy("host", "tokens").agg(F.sum("w").alias("w"))
    scored = told.select("host", "tokens", "host_words").join(scored, ["host", "tokens"], "left")
    scored = scored.select("host", "tokens", "host_words", (F.coalesce("w", F.lit(0.0)) + prior).alias("block_odds"))
    out = base.join(scored, ["host", "tokens"])
    verdict = F.coalesce(F.col("by.verdict"), F.when(F.col("block_odds") > 0, "block").otherwise("allow"))
    return unpack(out, pages.columns, host=F.col("host"), path=F.col("path"), rule=F.col("by.rule"), verdict=verdict, host_words=F.col("host_words"), block_odds=F.col("block_odds"))
