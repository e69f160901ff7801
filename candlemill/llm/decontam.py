"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

A text becomes a row of tokens (runs of letters, numbers, names), and its template replaces numbers by ``0``, units after
a number by ``1`` and names (capitalised words inside a sentence, several in a row as one) by ``2``. Windows of ``width``
template tokens are hashed and joined with the benchmark's. Windows of one alignment of a document and an item must
fill their placeholders consistently: one value of the item always meets one value of the document. So a question with
other numbers is found, and a chance meeting of bare patterns is not. Of an alignment that is not consistent, the windows
whose values equal the item's still count: a copy with one of two equal numbers edited is a copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from candlemill.sources.series import written

BROADCAST_ROWS = 1_000_000
OPEN, CLOSE = "␂", "␃"
NAME = r"([\p{Ll}\p{N},;:] )(\p{Lu}\p{L}*(?: \p{Lu}\p{L}*)*)"
TOKEN = OPEN + "[^" + CLOSE + "]*" + CLOSE + r"|[0-9]+(?:[.,:/][0-9]+)*|\p{L}+"
# The same for Java with possessive groups: its greedy ones call themselves once a repetition, so a long list of names or numbers overflows the stack
# and ends the executor. Nothing follows a group that it could give back to, so both match alike.
LONG_NAME, LONG_TOKEN = NAME.replace(")*)", ")*+)"), TOKEN.replace("+)*|", "+)*+|")
# Units.
UNITS = (
    "mm", "cm", "m", "km", "in", "ft", "yd", "mi", "mg", "g", "kg", "t", "oz", "lb", "lbs", "ml", "l", "s", "sec", "min", "h", "hr", "hrs", "day", "days",
    "week", "weeks", "month", "months", "year", "years", "second", "seconds", "minute", "minutes", "hour", "hours", "meter", "meters", "metre", "metres",
    "kilometer", "kilometers", "mile", "miles", "gram", "grams", "kilogram", "kilograms", "pound", "pounds", "liter", "liters", "litre", "litres", "inch",
    "inches", "foot", "feet", "yard", "yards", "dollar", "dollars", "euro", "euros", "cent", "cents", "usd", "eur", "percent", "degrees", "kmh", "mph",
)


def tokens_of(text: Column) -> Column:
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), LONG_NAME, f"$1{OPEN}$2{CLOSE}")
    return F.regexp_extract_all(marked, F.lit(f"({LONG_TOKEN})"), 1)


def _is_number(token: Column) -> Column:
    return (token >= F.lit("0")) & (token < F.lit(":"))


def template_of(tokens: Column) -> Column:
    units = [F.lit(u) for u in UNITS]

    def placed(token: Column, i: Column) -> Column:
        follows = (i > 0) & _is_number(F.element_at(tokens, F.greatest(i, F.lit(1))))
        return (
            F.when(_is_number(token), F.lit("0")).when(token.startswith(OPEN), F.lit("2"))
            .when(follows & F.lower(token).isin(*units), F.lit("1")).otherwise(F.lower(token)))

    return F.transform(tokens, placed)


def _windows(template: Column, width: int) -> Column:
    """Hashes of the windows of ``width`` tokens; null when there are fewer."""
    n = F.size(template) - width + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(template, i, width), F.lit(width))))


def _tabled(rows: DataFrame, width: int, keep: list[str], texts: bool) -> DataFrame:
    """One row per window: ``keep``, ``at`` (from 1), ``hash`` and, with ``texts``, the window's own tokens."""
    hashes = _windows(F.col("template"), width)
    if not texts:
        return rows.select(*keep, F.posexplode(hashes).alias("at", "hash"))
    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), (i + 1).alias("at"), F.slice("tokens", i + 1, width).alias("own"), F.slice("template", i + 1, width).alias("form")))
    return rows.select(*keep, F.explode(pairs).alias("w")).select(*keep, (F.col("w.at") - 1).alias("at"), "w.hash", "w.own", "w.form")


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    width: int = 5, coverage: float = 0.4, shortest: int = 3,
) -> DataFrame:
    """One row per document and benchmark item that it leaks: ``doc_id``, ``th`` (hash of the text), ``item_id``,
    ``matched``, ``windows``.

    A leak covers at least ``coverage`` of the item's windows in alignments with consistent slots, or by windows that
    hold the item's own values. Items with fewer
    than ``width`` tokens are one window of all their tokens; with fewer than ``shortest`` they are never met. Null and
    empty texts leak nothing. Repeated rows of one id and text give one row, as do repeated items. Ids may be null.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), tokens_of(F.col(item_text)).alias("tokens")).distinct()
    items = items.filter(F.size("tokens") >= shortest).withColumn("template", template_of(F.col("tokens")))
    items = written(items.withColumn("width", F.least(F.size("template"), F.lit(width))).withColumn("item", F.xxhash64("item_id", "tokens")), "leak-items")
    widths = [r[0] for r in items.select("width").distinct().collect()]  # at most ``width`` values
    base = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), tokens_of(F.col(text)).alias("tokens"))

    def met(rows: DataFrame, texts: bool) -> DataFrame | None:
        """Windows of ``rows`` that some item has too."""
        out = None
        formed = rows.withColumn("template", template_of(F.col("tokens")))
        for w in sorted(widths):
            theirs = written(_tabled(items.filter(F.col("width") == w), w, ["item", "item_id"], True).select(
                "item", "item_id", "hash", F.col("at").alias("item_at"), F.col("own").alias("item_own"), F.col("form").alias("item_form")), "leak-windows")
            if not texts:
                theirs = theirs.select("item", "item_id", "hash", "item_at")
            if theirs.count() <= BROADCAST_ROWS:
                theirs = F.broadcast(theirs)
            one = _tabled(formed, w, ["doc_id", "th"], texts).join(theirs, "hash").drop("hash", "form")
            out = one if out is None else out.unionByName(one)
        return out

    sizes = items.select("item", "item_id", (F.size("template") - F.col("width") + 1).alias("windows"), F.exists("template", lambda t: t.isin("0", "1", "2")).alias("slots"))
    empty = docs.sparkSession.createDataFrame([], "doc_id long, th long, item_id long, matched long, windows int")
    if not widths:
        return empty.select(F.col("doc_id").cast(docs.schema[doc_id].dataType).alias("doc_id"), "th", F.col("item_id").cast(benchmark.schema[item_id].dataType).alias("item_id"), "matched", "windows")
    hits = met(base, False).groupBy("doc_id", "th", "item").agg(F.count_distinct("item_at").alias("matched"))
    enough = F.col("matched") >= F.lit(coverage) * F.col("windows")
    likely = written(hits.join(sizes, "item").filter(enough), "leak-candidates")
    plain = likely.filter("NOT slots").select("doc_id", "th", "item_id", "matched", "windows")
    slotted = likely.filter("slots")
    if not slotted.head(1):
        return plain.distinct()
    # texts with candidate items that have placeholders, once more, now with the values in the slots
    some = slotted.select("doc_id", "th").distinct()
    if some.count() <= BROADCAST_ROWS:
        some = F.broadcast(some)
    again = base.alias("b").join(some.alias("s"), F.col("b.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("b.th") == F.col("s.th")), "left_semi")
    both = F.filter(
        F.zip_with(F.arrays_zip("item_own", "item_form"), F.col("own"), lambda i, d: F.struct(i["item_own"].alias("theirs"), i["item_form"].alias("form"), d.alias("ours"))),
        lambda p: p["form"].isin("0", "1", "2"))
    aligned = met(again.distinct(), True).select("doc_id", "th", "item", "item_at", (F.col("at") - F.col("item_at")).alias("shift"), both.alias("slots"))
    keys = ["doc_id", "th", "item", "shift"]
    pairs = aligned.select(*keys, F.explode("slots").alias("s")).select(*keys, "s.theirs", "s.ours").distinct()
    bad = pairs.groupBy(*keys, "theirs").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys, F.lit(True).alias("theirs_differ")).distinct()
    a, b = aligned.alias("a"), bad.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    for k in keys[1:]:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    fine = a.join(b, same, "left").filter(F.col("b.theirs_differ").isNull() | F.forall("a.slots", lambda s: s["theirs"] == s["ours"]))
    fine = fine.select("a.doc_id", "a.th", "a.item", "a.item_at").groupBy("doc_id", "th", "item").agg(F.count_distinct("item_at").alias("matched"))
    kept = fine.join(sizes, "item").filter("slots").filter(enough)
    return plain.unionByName(kept.select("doc_id", "th", "item_id", "matched", "windows")).distinct()


def remove_leaks(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """``docs`` without the documents that leak a benchmark item."""
    leaks = find_leaks(docs, benchmark, doc_id=doc_id, text=text, **more).select("doc_id", "th").distinct()
    th = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    return docs.alias("d").join(leaks.alias("l"), F.col(f"d.{doc_id}").eqNullSafe(F.col("l.doc_id")) & (th == F.col("l.th")), "left_anti")
