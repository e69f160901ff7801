"""Lists of thousands of names or numbers in one text."""

from __future__ import annotations

from candlemill.llm import decontam


def test_long_lists_of_names_and_numbers_do_not_end_the_executor(spark):
    item = "Before noon the tank holds 120 litres of water and a pump then drains it slowly until only half of it is left"
    names, numbers = "by " + " ".join(["Abc"] * 20_000), "codes " + ".".join(["17"] * 60_000)
    docs = spark.createDataFrame([(1, names + ". " + item), (2, numbers + " then. " + item), (3, names), (4, numbers)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = {r.doc_id: r for r in decontam.find_leaks(docs, bench).collect()}
    assert set(found) == {1, 2} and all(r.matched >= r.windows - 1 for r in found.values())
