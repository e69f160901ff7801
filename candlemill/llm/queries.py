"""Registered queries of the dealt operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from candlemill.llm import ann, decontam, dense_rank, katz, kd_shards, mixing, near_dup, page_text, pu_quality, repair_tokens, url_filter, variants, warc
from candlemill.llm.columns import id_remainder
from candlemill.session import scratch_path
from candlemill.sources.series import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op6_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sized = written(docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("n_words")), "document-lengths")
    mixed = mixing.mix(sized, length=F.col("n_words"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


@query
def op10_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = kd_shards.kd_shards(docs, 24, keep=["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op7_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_captures(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    captures = warc.assemble(warc.read_records(spark, path, payloads=False))
    return captures.select(
        F.col("metadata.page_id").alias("page_id"), F.coalesce("response.payload_bytes", "metadata.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.record_type").alias("record_type"), F.col("refers_to_page").alias("refers_to"))


SQL["op7_warc_transactions"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(1 + (((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT)) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f"""


@query
def op9_host_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    judged = url_filter.judge_urls(pages.select("page_id", "url"), texts=pages.select("html"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "host_words", "block_odds")


@query
def op8_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "repair-shards")
    repair_tokens.write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.path("word_bpe_49k.json"))
    return repair_tokens.read_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "block")


@query
def op3_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


SQL["op3_odd_sketch_dedup"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle FROM w, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS r(i) WHERE len(words) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
few AS (SELECT shingle FROM s GROUP BY shingle HAVING count(*) > 1),
c AS MATERIALIZED (SELECT doc_id, shingle FROM s WHERE shingle IN (SELECT shingle FROM few)),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have FROM c a JOIN c b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * both_have >= 85 * (nx.n + ny.n - both_have)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other),
comp AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT comp.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, comp.doc_id = component_id AS kept FROM comp LEFT JOIN n ON n.doc_id = comp.doc_id"""


@query
def op4_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("matched").cast("long").alias("matched"), F.col("windows").cast("long").alias("windows"))


_UNITS = ", ".join(f"'{u}'" for u in decontam.UNITS)


def _sql_tokens(table_name: str, id_name: str) -> str:
    return f"""SELECT DISTINCT {id_name}, text, tokens, list_transform(tokens, lambda t, i:
      CASE WHEN t >= '0' AND t < ':' THEN '0' WHEN starts_with(t, '{decontam.OPEN}') THEN '2'
           WHEN i > 1 AND tokens[i - 1] >= '0' AND tokens[i - 1] < ':' AND lower(t) IN ({_UNITS}) THEN '1' ELSE lower(t) END) AS template
    FROM (SELECT {id_name}, text, regexp_extract_all(regexp_replace(coalesce(text, ''), '{decontam.NAME}', '\\1{decontam.OPEN}\\2{decontam.CLOSE}', 'g'), '{decontam.TOKEN}') AS tokens FROM {table_name})"""


SQL["op4_template_leaks"] = f"""
WITH i0 AS ({_sql_tokens("benchmark", "item_id")}),
d0 AS ({_sql_tokens("documents", "doc_id")}),
i1 AS (SELECT *, least(len(template), 5) AS width FROM i0 WHERE len(tokens) >= 3),
iw AS MATERIALIZED (SELECT item_id, width, p AS item_at, array_to_string(template[p : p + width - 1], ' ') AS form, tokens[p : p + width - 1] AS item_own, template[p : p + width - 1] AS parts
       FROM i1, unnest(range(1, len(template) - width + 2)) AS r(p)),
dw AS (SELECT doc_id, text, width, q AS doc_at, array_to_string(template[q : q + width - 1], ' ') AS form, tokens[q : q + width - 1] AS own
       FROM d0, (SELECT DISTINCT width FROM i1) AS w, unnest(range(1, len(template) - width + 2)) AS r(q)),
met AS MATERIALIZED (SELECT doc_id, text, item_id, item_at, doc_at - item_at AS shift, own, item_own, parts FROM dw JOIN iw USING (width, form)),
bad AS (SELECT DISTINCT doc_id, text, item_id, shift FROM (
          SELECT DISTINCT doc_id, text, item_id, shift, item_own[k] AS theirs, own[k] AS ours FROM met, unnest(range(1, len(parts) + 1)) AS r(k) WHERE parts[k] IN ('0', '1', '2'))
        GROUP BY doc_id, text, item_id, shift, theirs HAVING count(*) > 1),
n AS (SELECT item_id, count(*) AS windows FROM iw GROUP BY item_id)
SELECT doc_id, item_id, count(DISTINCT item_at) AS matched, any_value(windows) AS windows FROM met JOIN n USING (item_id)
WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.doc_id = met.doc_id AND bad.text = met.text AND bad.item_id = met.item_id AND bad.shift = met.shift)
GROUP BY doc_id, text, item_id HAVING count(DISTINCT item_at) >= 0.4 * any_value(windows)"""


@query
def op5_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = pu_quality.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), pu_quality.score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query
def op1_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), recall=0.9)


# Exact neighbours: up to WINDOW vectors a query meets all of them.
SQL["op1_hilbert_neighbours"] = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_aggregate(list_transform(range(1, len(q.x) + 1), lambda k: q.x[k] * c.x[k]), 'sum') AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""


@query
def op2_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), pooled=True)


@query
def op11_dense_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_rank.rank_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL["op11_dense_rank"] = f"""
WITH d AS (SELECT doc_id, terms, len(terms) AS n FROM (SELECT doc_id, {_TERMS} AS terms FROM documents) WHERE len(terms) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
q AS MATERIALIZED (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY 1, 2),
p AS MATERIALIZED (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, docs),
r AS (SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // total))))) AS BIGINT) AS score
      FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 20"""


@query
def op12_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return page_text.extract_text(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op13_trie_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variant_forms(variants.corpus_words(table(spark, sf_dir, "documents").select("doc_id", "text")))


# crc32 by its table of 256 remainders; near words meet by what is left when one character is taken out.
SQL["op13_trie_variants"] = r"""
WITH RECURSIVE t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
             FROM range(256) AS r(i))),
runs AS MATERIALIZED (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, run, count(*) AS n FROM (SELECT doc_id,
             unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY 1, 2),
coded AS (SELECT id, run, n, hex(encode(id || ':' || run)) AS h FROM runs),
crc AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS INT), 2) AS BIGINT))),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM coded, t),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % len(run) AS INT)) || substr(run, CAST(h % len(run) AS INT) + 2)
             ELSE run END AS word FROM crc) WHERE len(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS MATERIALIZED (SELECT word, n, CAST(i AS INT) AS i, substr(word, 1, CAST(i AS INT) - 1) || substr(word, CAST(i AS INT) + 1) AS rest FROM words, unnest(range(1, len(word) + 1)) AS r(i)),
near AS MATERIALIZED (SELECT DISTINCT word, other, other_n FROM (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION ALL SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION ALL SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word)),
best AS (SELECT word, count(*) AS n_near, min({'n': -other_n, 'w': other}) AS b FROM near GROUP BY word),
formed AS MATERIALIZED (SELECT w.word, CASE WHEN -b.n >= 2 * w.n THEN b.w END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.n >= 2 * w.n THEN -b.n END AS form_n
             FROM words w LEFT JOIN best ON best.word = w.word),
walk(word, place) AS (SELECT word, word FROM formed UNION ALL SELECT walk.word, form FROM walk JOIN formed ON formed.word = walk.place WHERE form IS NOT NULL)
SELECT f.word, form, place AS root, n, n_near, form_n FROM formed f JOIN walk ON walk.word = f.word WHERE walk.place IN (SELECT word FROM formed WHERE form IS NULL)"""
