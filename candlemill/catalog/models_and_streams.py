"""ML, UDF and STR rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from candlemill.catalog import sql as S
from candlemill.catalog.bars_and_features import r6
from candlemill.catalog.pattern_rows import ALL, PIVOTS, _key
from candlemill.catalog.registry import add
from candlemill.catalog.trading import EV_SQL, PROC, events, plan_sql, proc_trades
from candlemill.models import training as M
from candlemill.models.boosting import split_gains, tree_nodes
from candlemill.operators import dataset as D, features as T
from candlemill.operators.bars import build_bars
from candlemill.session import scratch_path
from candlemill.sources import views as V
from candlemill.sources.series import stored, written
from candlemill.streaming import queries as Q

NUM, CAT = ["n_chars", "n_words", "digit_share"], ["lang", "source"]
_FITTED: dict[tuple, tuple] = {}


def quality_rows(s, d) -> DataFrame:
    """Labelled documents: whole-text counts as inputs, quality as label, hash split by document."""

    def build():
        x = V.table(s, d, "documents").join(V.table(s, d, "labels"), "doc_id")
        words = F.size(F.split(F.trim("text"), r"\s+"))
        u = D.hash_fraction(F.concat_ws("|", F.lit("q"), F.col("doc_id").cast("string")))
        return x.select(
            "doc_id", "lang", F.when(F.col("doc_id") % 10 == 3, F.lit(None)).otherwise(F.col("source")).alias("source"), F.col("quality").alias("label"),
            F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.col("n_chars")).cast("double").alias("n_chars"), words.cast("double").alias("n_words"),
            (F.length(F.regexp_replace("text", "[^0-9]", "")) / F.greatest(F.length("text"), F.lit(1))).alias("digit_share"),
            F.when(u < 0.6, "train").when(u < 0.8, "validation").otherwise("test").alias("split"))

    return stored(s, ("quality", d), build)


def fitted(s, d):
    key = (s.sparkContext.applicationId, d)
    if key not in _FITTED:
        _FITTED[key] = M.train_and_select(quality_rows(s, d), NUM, CAT, "label", [0.5], "doc_id", rounds=64, epochs=20)
    return _FITTED[key]


def train(s, d):
    return quality_rows(s, d).filter("split = 'train'")


def _median(s, d):
    x = M.with_missing_flags(quality_rows(s, d), NUM, CAT)
    out = M.median_pipeline(NUM, CAT).fit(x.filter("split = 'train'")).transform(x)
    return out.select("doc_id", "split", F.size(M.vector_to_array("features")).alias("width"), r6("first", M.vector_to_array("features")[0]), F.col("missing_n_chars").cast("long").alias("missing_n_chars"))


QR = """qr AS (SELECT d.doc_id, d.lang, CASE WHEN d.doc_id % 10 = 3 THEN NULL ELSE d.source END AS source, l.quality AS label, CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE d.n_chars END::DOUBLE AS n_chars,
  ('0x' || substr(sha256('q|' || d.doc_id), 1, 16))::UBIGINT / 18446744073709551616.0::DOUBLE AS u FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


def _moments(s, d):
    p = M.fit_preparation(train(s, d), NUM, CAT)
    x = quality_rows(s, d).withColumns({"z": p.columns()["z_n_chars"], "miss": p.columns()["missing_n_chars"]})
    return x.select("doc_id", r6("z"), F.col("miss").cast("long").alias("miss"))


add("ML1_median_preparation", _median)
add("ML2_train_only_moments", _moments,
    f"""WITH {QR}, m AS (SELECT avg(n_chars) AS a, sqrt(var_pop(n_chars) * count(n_chars) / count(*)) AS sc FROM qr WHERE u < 0.6)
    SELECT doc_id, round((coalesce(n_chars, a) - a) / sc, 6) AS z, CASE WHEN n_chars IS NULL THEN 1 ELSE 0 END AS miss FROM qr, m""")


def _vocab(s, d):
    p = M.fit_preparation(train(s, d), NUM, CAT, max_categories=4)
    cols = p.columns()
    x = quality_rows(s, d).select("doc_id", F.array_compact(F.array(*[F.when(cols[n] == 1.0, F.lit(n)) for n in p.names if n.startswith("source=")])).alias("t"))
    return x.select("doc_id", F.get("t", F.lit(0)).alias("token"), F.size("t").cast("long").alias("hits"))


add("ML2_capped_vocabulary", _vocab,
    f"""WITH {QR}, v AS (SELECT source FROM qr WHERE u < 0.6 AND source IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, source LIMIT 2)
    SELECT doc_id, 'source=' || CASE WHEN source IS NULL THEN '<MISSING>' WHEN source IN (SELECT source FROM v) THEN source ELSE '<UNKNOWN>' END AS token, 1 AS hits FROM qr""")


def _scores(name):
    def run(s, d):
        _, fits, prep = fitted(s, d)
        x = prep.apply(quality_rows(s, d).withColumn("label", F.col("label").cast("double")))
        return M.predict(fits[name], x).select("doc_id", "split", r6("probability"))
    return run


add("ML3_logistic_scores", _scores("logistic"))
add("ML4_boosted_tree_scores", _scores("boosted_trees"))
add("ML5_perceptron_scores", _scores("perceptron"))


def _contract(s, d):
    _, fits, prep = fitted(s, d)
    x = prep.apply(quality_rows(s, d).withColumn("label", F.col("label").cast("double")))
    out = None
    for n, m in fits.items():
        one = M.predict_with(lambda df, m=m: M.predict(m, df), x).agg(
            F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("probability").between(0, 1), 1)).alias("in_range")).withColumn("model", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


add("ML6_predictor_contract", _contract,
    f"""WITH {QR} SELECT count(*) AS rows, count(*) AS in_range, m AS model FROM qr, (VALUES ('logistic'), ('boosted_trees'), ('perceptron')) v(m) GROUP BY m""")
add("ML7_importances", lambda s, d: M.importances(s, fitted(s, d)[1]["logistic"], fitted(s, d)[2].names).select("feature", r6("coefficient"), r6("magnitude")))
add("ML7_split_gains", lambda s, d: split_gains(tree_nodes(fitted(s, d)[1]["boosted_trees"].model), fitted(s, d)[2].names).select("feature", "splits", r6("mean_gain"), r6("importance")))
add("ML8_permutation_importance", lambda s, d: M.permutation_importance(
    fitted(s, d)[1]["logistic"], fitted(s, d)[2], quality_rows(s, d).filter("split = 'test'").withColumn("label", F.col("label").cast("double")), NUM, "doc_id", "label").select("feature", r6("auc_drop")))
add("ML9_model_comparison", lambda s, d: fitted(s, d)[0].select("model", r6("validation_roc_auc"), r6("test_roc_auc"), r6("test_brier_score"), "primary_model"))

# --- UDF ---------------------------------------------------------------------------------------------
add("UDF1_bar_columns_contract",
    # Any table with run_id, bar_index and close is a bar table: features need no other type.
    lambda s, d: T.relative_log_price(V.table(s, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("run_id"), (F.col("l_linenumber") - 1).cast("long").alias("bar_index"),
        F.col("l_extendedprice").alias("close")).groupBy("run_id", "bar_index").agg(F.max("close").alias("close"))).groupBy("run_id").agg(F.count(F.lit(1)).alias("bars"), r6("top", F.max("rel_log"))),
    """WITH b AS (SELECT CAST(l_orderkey AS VARCHAR) AS run_id, l_linenumber - 1 AS i, max(l_extendedprice) AS close FROM lineitem GROUP BY 1, 2), f AS (SELECT run_id, close AS c0 FROM b WHERE i = 0)
    SELECT run_id, count(*) AS bars, round(max(ln(close) - ln(c0)), 6) AS top FROM b JOIN f USING (run_id) GROUP BY 1""")
def scored_ticks(s, d) -> DataFrame:
    """Any table with run_id, step, a price and a volume is a tick table."""
    step = F.row_number().over(Window.partitionBy("run_id", "entry_index").orderBy("row_id")) - 1
    return V.order_trades(s, d).select(F.concat_ws("-", "pattern_type", "run_id", F.col("entry_index").cast("string")).alias("run_id"), step.alias("step"),
                                       F.col("probability").alias("price"), F.lit(1).alias("volume"))


add("UDF2_tick_columns_contract",
    lambda s, d: build_bars(scored_ticks(s, d), 1).groupBy("bar_index").agg(F.count(F.lit(1)).alias("bars"), r6("high", F.max("high"))),
    f"""WITH {S.ORDER_TRADES}, t AS (SELECT pattern_type || '-' || run_id || '-' || entry_index AS r, probability, row_number() OVER (PARTITION BY run_id, entry_index ORDER BY row_id) - 1 AS bar_index FROM trades)
    SELECT bar_index, count(*) AS bars, round(max(probability), 6) AS high FROM t GROUP BY 1""")
add("UDF3_pluggable_predictor",
    lambda s, d: M.predict_with(lambda df: df.withColumn("probability", F.col("probability") * F.col("probability")), V.event_scores(s, d)).select("row_id", r6("probability")),
    f"WITH {S.SCORES} SELECT row_id, round(probability * probability, 6) AS probability FROM scores")

# --- STR ---------------------------------------------------------------------------------------------


def tick_stream(s, d) -> DataFrame:
    return Q.read_table_stream(s, d, "events").select(
        F.col("event_type").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("value") + 1.0).alias("price"), (1 + F.col("event_id") % 10).alias("volume"))


BATCH = 131_072  # bars of a run in one micro-batch: what one task holds


def price_stream(s, d) -> DataFrame:
    """The walk ticks as a stream: their drift is part of the numbered table."""
    return Q.ordered_batches(V.event_ticks(s, d).select("run_id", "step", "ts", "event_id", F.col("walk").alias("close")), BATCH, "walk-stream")


add("STR1_streaming_time_bars",
    lambda s, d: Q.run_to_end(Q.time_bars(tick_stream(s, d), "6 hours", "1 hour"), "time-bars").select(
        "run_id", F.unix_seconds("bar_start").alias("bar_start"), r6("open"), r6("high"), r6("low"), r6("close"), "volume", "ticks"),
    f"""WITH {S.TICKS}, w AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events), b AS (SELECT run_id, CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) AS bar_start, arg_min(price, ts) AS open, max(price) AS high,
      min(price) AS low, arg_max(price, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS ticks FROM ticks GROUP BY 1, 2)
    SELECT run_id, bar_start, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume, ticks FROM b, w WHERE bar_start + 21600 <= epoch(mark)""")
add("STR2_streaming_count_bars",
    lambda s, d: Q.run_to_end(Q.count_bars(tick_stream(s, d), 5), "count-bars").select("run_id", "bar_index", r6("open"), r6("high"), r6("low"), r6("close"), "volume"),
    f"""WITH {S.TICKS}, b AS (SELECT run_id, step // 5 AS bar_index, arg_min(price, step) AS open, max(price) AS high, min(price) AS low, arg_max(price, step) AS close, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS n FROM ticks GROUP BY 1, 2)
    SELECT run_id, bar_index, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM b WHERE n = 5""")
add("STR3_streaming_shapes",
    lambda s, d: Q.run_to_end(Q.detect_shapes(price_stream(s, d), ALL), "shapes").select("run_id", F.col("core_length").cast("long").alias("core_length"), "window_end", r6("noise", digits=8), F.col("pivots").cast("long").alias("pivots"), "last_pivot"),
    f"""WITH RECURSIVE {PIVOTS} SELECT {_key("pv")}, pv.we AS window_end, round(max(noise), 8) AS noise, count(*) AS pivots, CASE WHEN arg_max(kd, i) = 1 THEN 'max' ELSE 'min' END AS last_pivot
    FROM pv JOIN nz ON nz.run_id = pv.run_id AND nz.we = pv.we GROUP BY 1, 2, 3""")


def guarded(s, d) -> DataFrame:
    """Resolved signals of the five-bar horizon, streamed through the guard."""
    from candlemill.operators.overlap import resolve_same_entry
    from candlemill.operators.trades import with_portfolio
    e = with_portfolio(events(s, d).filter("direction is not null")).withColumn("exit_index", F.col("entry_index") + 4)
    r = resolve_same_entry(e, ["run_id", "hypothesis"]).filter("NOT _conflict AND _rank = 1")
    t = written(r.select("run_id", "hypothesis", "event_id", "entry_index", "exit_index"), "signal-stream")
    src = s.readStream.schema(t.schema).parquet(t.inputFiles()[0].rsplit("/", 1)[0])
    return Q.run_to_end(Q.position_guard(src), "guard")


add("STR4_streaming_position_guard",
    lambda s, d: guarded(s, d).select("run_id", "hypothesis", "event_id", "entry_index", "accepted"),
    f"""WITH RECURSIVE {EV_SQL}, hyp AS (SELECT *, pattern_name AS hypothesis FROM ev WHERE direction IS NOT NULL UNION ALL SELECT *, '__all_patterns__' FROM ev WHERE direction IS NOT NULL),
    good AS (SELECT *, entry_index + 4 AS exit_index, min(direction) OVER g <> max(direction) OVER g AS conflict, row_number() OVER (PARTITION BY run_id, hypothesis, entry_index ORDER BY
      CASE pattern_name WHEN 'rectangle' THEN 3 WHEN 'double_top' THEN 5 ELSE 6 END, event_id) AS rk FROM hyp WINDOW g AS (PARTITION BY run_id, hypothesis, entry_index)),
    seq AS (SELECT *, row_number() OVER (PARTITION BY run_id, hypothesis ORDER BY entry_index) AS rn FROM good WHERE NOT conflict AND rk = 1),
    rec AS (SELECT run_id, hypothesis, rn, event_id, entry_index, exit_index AS ou, true AS accepted FROM seq WHERE rn = 1
      UNION ALL SELECT q.run_id, q.hypothesis, q.rn, q.event_id, q.entry_index, CASE WHEN q.entry_index > r.ou THEN q.exit_index ELSE r.ou END, q.entry_index > r.ou
      FROM rec r JOIN seq q ON q.run_id = r.run_id AND q.hypothesis = r.hypothesis AND q.rn = r.rn + 1)
    SELECT run_id, hypothesis, event_id, entry_index, accepted FROM rec""")


def trade_stream(s, d) -> DataFrame:
    t = written(V.order_trades(s, d).select("run_id", "row_id", "net_directional_return", "profitable").repartition(4, "row_id"), "trade-stream")
    return s.readStream.schema(t.schema).option("maxFilesPerTrigger", 2).parquet(t.inputFiles()[0].rsplit("/", 1)[0])


add("STR5_streaming_run_metrics",
    lambda s, d: Q.run_metrics_stream(trade_stream(s, d), "run-metrics").select("run_id", "trades", r6("net_return", digits=10), r6("success_rate")),
    f"WITH {S.ORDER_TRADES} SELECT run_id, count(*) AS trades, round(sum(net_directional_return), 10) AS net_return, round(avg(profitable), 6) AS success_rate FROM trades GROUP BY 1")


def resumed(s, d) -> DataFrame:
    """Two halves arrive one after the other; the second start reads only what is new."""
    o = V.table(s, d, "orders").select("o_orderkey", "o_custkey")
    inbox, out, progress = (scratch_path(s, f"resume-{x}") for x in ("in", "out", "progress"))
    o.filter("o_orderkey % 2 = 0").write.mode("append").parquet(inbox)
    stream = lambda: s.readStream.schema(o.schema).parquet(inbox)
    Q.run_to_end(stream(), "resume", progress, out)
    o.filter("o_orderkey % 2 = 1").write.mode("append").parquet(inbox)
    return Q.run_to_end(stream(), "resume", progress, out)


add("STR6_resume_after_stop", lambda s, d: resumed(s, d), "SELECT o_orderkey, o_custkey FROM orders")
add("STR7_signal_sessions",
    lambda s, d: Q.run_to_end(Q.sessions(tick_stream(s, d), "20 minutes", "1 hour"), "sessions").select(
        "run_id", F.unix_micros("session_start").alias("session_start"), "signals", "volume"),
    f"""WITH {S.TICKS}, w AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY run_id ORDER BY ts) <= INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS nw FROM ticks),
    k AS (SELECT *, sum(nw) OVER (PARTITION BY run_id ORDER BY ts) AS sid FROM g), q AS (SELECT run_id, sid, min(ts) AS a, max(ts) AS b, count(*) AS n, CAST(sum(volume) AS BIGINT) AS v FROM k GROUP BY 1, 2)
    SELECT run_id, epoch_us(a) AS session_start, n AS signals, v AS volume FROM q, w WHERE b + INTERVAL 20 MINUTE <= mark""")
