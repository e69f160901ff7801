"""Each operator on small tables: nulls, empty and very long texts, ties, repeats, empty tables, clashing column names."""

import base64
import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from katz_brute import scores as katz_brute
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from candlemill.llm import ann, components, decontam, katz, kd_shards, mixing, near_dup, pu_quality, repair_tokens, text_arrays, url_filter, warc
from candlemill.session import scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977} x{i % 13}." for i in range(60_000))


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def docs(spark, rows, extra=True):
    """(doc_id, text, source) rows with columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({"_row": F.lit(1), "size_": F.lit(2), "key": F.lit("k"), "node": F.lit(3), "id": F.lit(4), "rank": F.lit(5)}) if extra else df


CASES = [
    (1, "The cat sat on the mat and then it ran", "a"), (2, "the CAT sat on the mat and then it ran", "b"), (3, None, None), (4, "", "a"), (5, "  \n ", None),
    (6, "one two", "c"), (7, "ONE  two", "a"), (8, LONG, "b"), (9, LONG + " tail", "b"), (None, "lonely words of a row without id", "a"),
    (10, "à é ü words ñ", "c"), (1, "The cat sat on the mat and then it ran", "a"), (11, "the cat sat on the mat and then it ran far", "a"),
]


# --- words and shingles -------------------------------------------------------------------------------------------


def test_word_hashes_see_the_words_and_nothing_else():
    import pyarrow as pa

    texts = ["a b  C", "", None, "\t c\x0bA\x1cb", "B", LONG, "x" * 100_000, "é É"]
    words, at = {}, []
    for row, data, offsets in text_arrays.text_pieces(pa.array(texts)):
        got, starts = text_arrays.word_hashes(data, offsets)
        for i in range(len(starts) - 1):
            at.append(got[starts[i] : starts[i + 1]].tolist())
    for t, hashes in zip(texts, at):
        own = WORD.findall(lower(t))
        assert len(own) == len(hashes)
        for w, h in zip(own, hashes):
            assert words.setdefault(w, h) == h
    assert len(set(words.values())) == len(words)


# --- near-duplicates ----------------------------------------------------------------------------------------------


def brute_components(rows, percent):
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, *_) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, *_), s) in enumerate(zip(rows, sets))), key=str)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_match_brute_force(spark, percent):
    found = near_dup.near_duplicates(docs(spark, CASES), percent=percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute_components(CASES, percent)


def test_a_group_larger_than_a_block_loses_no_link(spark):
    draw = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(420):
        words = list(base)
        for _ in range(draw.integers(0, 6)):
            words[draw.integers(0, 150)] = f"v{draw.integers(0, 40)}"
        rows.append((i, " ".join(words), "s"))
    found = near_dup.near_duplicates(docs(spark, rows, extra=False), percent=85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute_components(rows, 85)


def test_keep_one_of_each_group(spark):
    kept = near_dup.keep_one(docs(spark, CASES), percent=80).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted([1, 3, 4, 5, 6, 8, None, 10], key=str)
    assert set(kept[0].asDict()) == set(docs(spark, CASES).columns)
    assert near_dup.near_duplicates(docs(spark, [])).count() == 0


def test_keep_one_does_not_mix_groups_without_an_id_of_their_own(spark):
    """Unrelated texts stay, whether they have no id or share one; of near copies among them one stays."""
    copy = " ".join(f"c{i}" for i in range(60))
    rows = [(None, "first text that has no id", "a"), (None, "second and wholly other text without one", "a"), (None, "third text, unlike both", "a"), (None, "third text, unlike both", "a"),
            (5, "a text under the id five", "b"), (5, "something else that is numbered alike", "b"), (5, "", "b"), (None, None, "b"), (None, copy, "c"), (None, copy + " more", "c"), (5, copy + " most", "c")]
    kept = near_dup.keep_one(docs(spark, rows), percent=80).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted({(i, t) for i, t, _ in rows} - {(None, copy), (None, copy + " more")}, key=str)
    alone = near_dup.keep_one(docs(spark, [r for r in rows if r[0] is None]), percent=80).collect()
    texts = [r.text for r in alone]
    assert len(texts) == 5 and set(texts) > {r[1] for r in rows[:4]} and len({copy, copy + " more"} & set(texts)) == 1


def test_the_callers_columns_survive_whatever_their_names(spark):
    """Stages of the pipeline give back the columns of their input with its values."""
    names = ["_th", "th", "_copy", "copies", "size", "taken", "target", "source_size", "_row", "id"]
    df = docs(spark, CASES, extra=False).withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id"), F.lit(0))) for n in names})
    for rows in (near_dup.keep_one(df, percent=80), mixing.take(df)):
        assert rows.columns == df.columns and rows.count() > 0
        assert all(r[n] == f"{n}{r.doc_id or 0}" for r in rows.collect() for n in names)
    clash = mixing.mix(docs(spark, CASES, extra=False).withColumn("_copy", F.lit("mine")))
    assert {r["_copy"] for r in mixing.mixed_rows(clash).collect()} == {"mine"}


def test_screen_and_bands():
    assert (1 - 0.85**4) ** near_dup.bands_for(0.85) <= 1e-7
    sets = [np.arange(300, dtype=np.uint64) * np.uint64(7919), np.arange(12, 300, dtype=np.uint64) * np.uint64(7919)]
    sketch = np.array([np.frombuffer(s.tobytes(), np.uint64) for s in near_dup.sign_sets(sets, 22)[1]])
    assert near_dup._differing(sketch, sketch)[0, 1] <= near_dup.screen(0.85, 88)


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in components.components(edges).collect()} == {0}


# --- budget mix ---------------------------------------------------------------------------------------------------


def test_fit_budget_is_exact_where_it_can_be():
    draw = np.random.default_rng(1)
    for _ in range(200):
        n = int(draw.integers(1, 7))
        lengths = sorted(set(draw.integers(0, 12, n).tolist()))
        counts = draw.integers(1, 4, len(lengths)).tolist()
        budget = int(draw.integers(0, 60))
        taken = mixing.fit_budget(lengths, counts, budget)
        assert all(0 <= k <= c for k, c in zip(taken, counts))
        got = sum(x * k for x, k in zip(lengths, taken))
        assert got <= budget
        sums = {sum(x * k for x, k in zip(lengths, p)) for p in itertools.product(*[range(c + 1) for c in counts])}
        assert got >= max(s for s in sums if s <= budget) - max(lengths)


def brute_targets(sizes, share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, free = share * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] >= most * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


def test_mix_meets_targets_and_repeats(spark):
    draw = np.random.default_rng(3)
    rows = [(i, " ".join("w" * int(n)), f"s{i % 5}" if i % 11 else None) for i, n in enumerate(draw.integers(0, 30, 300))] + CASES[:8]
    df = docs(spark, rows)
    mixed = mixing.mix(df).collect()
    assert len(mixed) == len(rows)
    sizes, taken, target, longest = Counter(), Counter(), {}, Counter()
    for r in mixed:
        longest[r.source] = max(longest[r.source], r.size)
        assert r.size == len(WORD.findall(r.text or "")) and r.taken <= 2 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    want = brute_targets(dict(sizes))
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= max(1, longest[s])
        if s and s.startswith("s"):  # many lengths: met to the word
            assert abs(taken[s] - want[s]) <= 1
    again = mixing.mix(df.repartition(7)).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in mixed) == Counter((r.doc_id, r.size, r.taken) for r in again)
    assert mixing.mixed_rows(mixing.mix(df)).count() == sum(r.copies for r in mixed if r["size"] > 0)
    assert Counter(r.doc_id for r in mixing.take(df).collect()) == Counter(i for r in mixed if r["size"] > 0 for i in [r.doc_id] * r.copies)
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.take(docs(spark, [])).count() == 0


# --- shards -------------------------------------------------------------------------------------------------------


def test_shards_are_even_gapless_and_keep_copies_together(spark):
    draw = np.random.default_rng(4)
    rows = [(i, "t" + "x" * int(n) + str(i // 2), "s") for i, n in enumerate(draw.integers(0, 400, 2000))] + [(9000 + i, "copy " * 30, "s") for i in range(900)] + CASES[:7]
    placed = kd_shards.kd_shards(docs(spark, rows), 7).collect()
    assert len(placed) == len(rows)
    size, slots = Counter(), defaultdict(list)
    for r in placed:
        n = len((r.text or "").encode()) + 8
        assert r.size == n and r.text_crc32 == zlib.crc32((r.text or "").encode())
        size[r.shard] += n
        slots[r.shard].append(r.slot)
    assert sorted(size) == list(range(7))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(size.values()) / 7
    assert max(abs(x - mean) for x in size.values()) < 0.1 * mean
    assert kd_shards.kd_shards(docs(spark, []), 4).count() == 0
    assert {r.shard for r in kd_shards.kd_shards(docs(spark, [(1, None, None)] * 3), 2).collect()} <= {0, 1}


# --- WARC ---------------------------------------------------------------------------------------------------------

PAGES = [
    (1, "http://a.org/x", "<p>one</p>"), (2, "http://b.org", "<p>one</p>"), (3, None, None), (4, "http://c.org/é\r\nx", ""), (5, "http://d.org/?q#f", "WARC/1.1\r\n\r\nWARC-Type: x\r\n\r\n"),
    (None, "http://e.org", "<p>one</p>"), (6, "http://f.org", LONG), (2, "http://b.org", "<p>one</p>"), (7, "u", "\r\n\r\n\x00ü"),
]


@pytest.mark.parametrize("at_least", [0, 5])
def test_warc_round_trip(spark, at_least):
    path = scratch_path(spark, "test-warc")
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"digest": F.lit("d"), "cid": F.lit(1)})
    warc.write_captures(pages, path, at_least=at_least)
    records = warc.read_records(spark, path)
    assert Counter(r.record_type for r in records.collect())["request"] == len(PAGES)
    rows = warc.assemble(records).collect()
    assert len(rows) == len(PAGES)
    firsts = {}
    for i, _, h in PAGES:
        if i is not None and len((h or "").encode()) >= at_least:
            firsts[h or ""] = min(firsts.get(h or "", i), i)
    text = {1: "<p>one</p>", 2: "<p>one</p>", 3: "", 4: "", 5: PAGES[4][2], None: "<p>one</p>", 6: LONG, 7: PAGES[8][2]}
    for r in rows:
        i, body = r.metadata.page_id, text[r.metadata.page_id].encode()
        assert r.request is not None and r.metadata.payload_bytes == len(body)
        assert r.response.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        first = firsts.get(text[i], i) if len(body) >= at_least else i
        if i == first and r.response.record_type == "response":
            assert r.response.payload == body and r.refers_to_page is None
        else:
            assert r.response.record_type == "revisit" and r.refers_to_page == first
    by = Counter((r.metadata.page_id, r.response.record_type) for r in rows)
    assert by[2, "revisit"] == 2 and by[1, "response"] == 1 and by[None, "revisit"] == 1


def test_warc_of_an_empty_table(spark):
    path = scratch_path(spark, "test-warc")
    warc.write_captures(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.assemble(warc.read_records(spark, path)).count() == 0


# --- token shards -------------------------------------------------------------------------------------------------

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_words_are_encoded_as_whole_texts_are():
    plain, own = Tokenizer.from_file(TOKENIZER), repair_tokens.WordEncoder(TOKENIZER)
    texts = ["it's <|endoftext|> ǅa Àé,, x́ b", "", "  ", "A\x00b!!$$ |x|", "ſK ﬁ x y \x85z", "don't 'll 12½ab| straße. ÀÉÎ!!", "́a Å", "日本 語x", LONG[:5000], "a\x1cb \xa0c\u2003d É", "Word WORD word, WORD, THE!! The|"]
    import pyarrow as pa

    assert [x.tolist() for x in own.encode_all(pa.array(texts))] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_of_a_tokenizer_that_keeps_case(tmp_path):
    """Case is folded only where the tokenizer does so itself."""
    import pyarrow as pa
    from tokenizers import models, pre_tokenizers

    own = Tokenizer(models.WordLevel({"[UNK]": 0, "cat": 1, "Cat": 2, ",": 3}, unk_token="[UNK]"))
    own.pre_tokenizer = pre_tokenizers.Whitespace()
    path = str(tmp_path / "cased.json")
    own.save(path)
    texts = ["Cat cat cat, Cat", "cat", "CAT Cat,"]
    assert [x.tolist() for x in repair_tokens.WordEncoder(path).encode_all(pa.array(texts))] == [own.encode(t).ids for t in texts]
    assert repair_tokens.WordEncoder(TOKENIZER).fold is str.lower


def test_added_tokens_are_told_apart_by_case():
    import pyarrow as pa

    plain = Tokenizer.from_file(TOKENIZER)
    texts = ["a <|ENDOFTEXT|> b", "a <|endoftext|> b", "The the THE,", "x<|EndOfText|>y X<|endoftext|>Y", "ÀÉ àé"]
    own = repair_tokens.WordEncoder(TOKENIZER)
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    for run in (texts, texts[::-1], texts):
        assert [x.tolist() for x in own.encode_all(pa.array(run))] == [want[texts.index(t)] for t in run]


def test_grammar_round_trip():
    draw = np.random.default_rng(2)
    for size, vocabulary in ((0, 5), (1, 5), (5_000, 3), (20_000, 200), (300, 70_000)):
        ids = draw.integers(0, vocabulary, size).astype(np.uint32)
        cuts = np.unique(np.concatenate(([0, size], draw.integers(0, size + 1, 9)))).astype(np.int64)
        block = repair_tokens.compress(ids, cuts, vocabulary)
        assert (repair_tokens.decode(block) == ids).all()
        assert block["id_starts"] == cuts.tolist() and (size == 0 or len(block["symbol_starts"]) == len(cuts))
        for a, b in ((0, size), (size // 3, size // 2), (size, size), (0, 1)):
            assert (repair_tokens.decode(block, a, b) == ids[a:b]).all()
    block = repair_tokens.compress(np.tile(np.arange(4, dtype=np.uint32), 1000), np.array([0, 4000]), 4)
    assert len(block["symbols"]) < 4000 and len(block["left"]) > 0


def test_token_shards(spark):
    path = scratch_path(spark, "test-tokens")
    repair_tokens.write_shards(docs(spark, CASES), path, TOKENIZER, block=5000)
    got = repair_tokens.read_index(spark, path).orderBy("start").collect()
    plain, at = Tokenizer.from_file(TOKENIZER), 0
    want = defaultdict(list)
    for i, t, _ in CASES:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        want[i].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    order = [r.doc_id for r in got]
    assert order == sorted((i for i, *_ in CASES), key=lambda i: (i is not None, i or 0))
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        at += r.n_tokens
    empty = scratch_path(spark, "test-tokens")
    repair_tokens.write_shards(docs(spark, []), empty, TOKENIZER)
    assert repair_tokens.read_index(spark, empty).count() == 0


# --- language model -----------------------------------------------------------------------------------------------


def test_katz_matches_dictionaries(spark):
    rows = [(i, t) for i, t, _ in CASES] + [(100 + i, "the cat " * (i % 4) + f"ran off {i % 9}") for i in range(60)]
    got = katz.katz_scores(docs(spark, [(*r, "s") for r in rows])).collect()
    want = Counter()
    for i, (tokens, known, n, base, score) in katz_brute(rows).items():
        want[rows[i][0], tokens, known, n, round(base, 6), round(score, 6)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == want


@pytest.mark.parametrize("tables", [None, 3])
def test_katz_of_pooled_statistics_does_not_depend_on_tables(spark, tables):
    rows = [(i, t) for i, t, _ in CASES] + [(100 + i, "the cat " * (i % 4) + f"ran off {i % 9} and sat on {i % 5} by {i % 7}") for i in range(60)]
    got = katz.katz_scores(docs(spark, [(*r, "s") for r in rows]), tables=tables, pooled=True).collect()
    want = katz_brute(rows, tables=1)  # one table: statistics of all pairs
    order = lambda r: (str(r[0]), r[1:])
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=order)
    for one, other in zip(got, sorted(((rows[i][0], *x) for i, x in want.items()), key=order), strict=True):
        assert one[:4] == other[:4] and one[4:] == pytest.approx(other[4:], rel=1e-9)


def test_katz_sums_to_one():
    """Over the words seen and the unknown one, after any context."""
    uni = katz.Unigrams.__new__(katz.Unigrams)
    counts = np.array([9, 7, 6, 3, 2, 2, 1, 1, 1, 1])
    uni.n, uni.v, uni.hot, uni.documents = int(counts.sum()), len(counts), {}, 1
    uni.d = katz.discounts([0, *[int((counts == r).sum()) for r in range(1, 7)]])
    uni.unknown = 1 - katz.discounted(counts, uni.d).sum() / uni.n
    p = np.append(10 ** uni.log10(counts), uni.unknown)
    assert p.sum() == pytest.approx(1) and uni.unknown > 0
    after = np.array([4, 0, 2, 1, 0, 0, 1, 0, 0, 0, 0])
    d = katz.discounts([0, 2, 1, 0, 1, 0, 0])
    mass, total, less = katz.discounted(after[after > 0], d).sum(), after.sum(), p[after > 0].sum()
    weight = katz.backoff_weight(np.array([mass]), np.array([total]), np.array([less]))[0]
    assert mass / total + weight * p[after == 0].sum() == pytest.approx(1)


def test_katz_without_anything_to_learn(spark):
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = katz.katz_scores(docs(spark, [(held, "a b", None)])).head()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.score) == (3, 0, 0, 0.0)
    assert katz.katz_scores(docs(spark, [])).count() == 0


# --- leaks --------------------------------------------------------------------------------------------------------


def test_template_leaks(spark):
    items = [
        (1, "If a train leaves at 9 and drives 120 km in 3 hours, how fast does Anna think 120 km per ride is?"), (2, "short item"), (3, None), (4, "four little words here"),
        (5, "The plain text of an item that has no slots at all but many words"), (5, "The plain text of an item that has no slots at all but many words"),
    ]
    held = [
        (1, "Intro. if a train leaves at 7 and drives 90 km in 2 hours, how fast does Bob think 90 km per ride is? end", None),  # other values, used alike
        (2, "Intro. If a train leaves at 7 and drives 90 km in 2 hours, how fast does Bob think 33 km per ride is? end", None),  # one value met twice, unlike
        (3, "the plain TEXT of an item that has no slots at all, but many words!", None), (4, "the plain text of a quite different kind with many other words", None),
        (5, None, None), (6, "", None), (None, "x the plain text of an item that has no slots at all but many words", None), (7, LONG + " four little words here " + LONG, None),
        (3, "the plain TEXT of an item that has no slots at all, but many words!", None),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("at", F.lit(1))
    got = decontam.find_leaks(docs(spark, held), bench)
    assert sorted(((r.doc_id, r.item_id) for r in got.collect()), key=str) == sorted([(1, 1), (3, 5), (None, 5), (7, 4)], key=str)
    left = decontam.remove_leaks(docs(spark, held), bench)
    assert sorted(r.doc_id for r in left.collect()) == [2, 4, 5, 6] and left.columns == docs(spark, held).columns
    assert decontam.find_leaks(docs(spark, []), bench).count() == 0
    assert decontam.find_leaks(docs(spark, held), bench.limit(0)).count() == 0


def test_a_copy_with_one_of_two_equal_values_edited_leaks(spark):
    text = "A tank holds 120 litres of water at noon and a pump then drains it slowly until only half is left, so how many of the 120 litres remain?"
    held = [(1, "Intro. " + text.replace("the 120", "the 130") + " end", None), (2, "Intro. " + text + " end", None), (3, "It held 120 litres of water, then 130 litres of it.", None)]
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.find_leaks(docs(spark, held), bench).collect()}
    assert set(got) == {1, 2} and got[2].matched == got[2].windows
    assert got[1].matched == got[1].windows - 3  # those over the edited number, the third token from the end


# --- quality ------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    read = lambda t: spark.read.parquet(f"{big}/{t}.parquet")
    model = pu_quality.train(read("documents"), read("labels"))
    assert 0.6 < model.prior < 0.99
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    table = read("documents").join(read("labels"), "doc_id").filter(held).withColumn("s", pu_quality.score_column(model, F.col("text"))).collect()
    good, bad = [r.s for r in table if r.quality == 1], [r.s for r in table if r.quality == 0]
    assert len(good) > 100 and len(bad) > 20
    assert np.mean([s >= 0.5 for s in good]) > 0.97 and np.mean([s < 0.5 for s in bad]) > 0.7


def test_quality_of_odd_rows(spark):
    table = docs(spark, CASES)
    labels = spark.createDataFrame([(i, 1) for i in range(12)] + [(2, 0), (None, 1), (4, None)], "doc_id long, quality int")
    scored = table.withColumn("s", pu_quality.score_column(pu_quality.train(table, labels), F.col("text"))).collect()
    assert len(scored) == len(CASES) and all(0 <= r.s <= 1 for r in scored)
    assert pu_quality.train(docs(spark, []), labels) is None and pu_quality.train(table, labels.limit(0)) is None


def test_prior_is_the_least_ratio():
    draw = np.random.default_rng(0)
    good, bad = draw.normal(2, 1, 40_000), draw.normal(-3, 1, 10_000)
    assert pu_quality.estimate_prior(draw.normal(2, 1, 20_000), np.concatenate([good, bad])) == pytest.approx(0.8, abs=0.02)


# --- urls ---------------------------------------------------------------------------------------------------------


def test_urls(spark):
    urls = [
        "http://cheappills.example.com/en/1", "https://www.casino-win.example.org/x", "http://green-garden.example.com/en/2", "http://greengarden.example.com/en/3", "http://x.EXAMPLE.net/en/9?q",
        "http://x.example.net/de/9", "http://example.com/de/", "http://a.org/fr/1#z", "http://borg/fr/1", None, "no host", "://", "http://net", "http://free-bets.example.com/a", "http://cheap-pills.example.com/",
        "http://" + "longname" * 300 + ".example.com/", "http://cheappills.example.com/en/1",
    ]
    urls += [f"http://site{i}.example.com/en/{i}" for i in range(60)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"name": F.lit(1), "tokens": F.lit(2)})
    texts = spark.createDataFrame([("<b>green garden</b> " * 5,), (None,)], "html string")
    rows = {r.page_id: r for r in url_filter.judge_urls(pages, texts=texts).collect()}
    assert len(rows) == len(urls)
    assert rows[0].host_words[:2] == ["cheap", "pills"] and rows[3].host_words[:2] == ["green", "garden"]
    assert [rows[i].verdict for i in (0, 1, 2, 3, 13, 14, 16)] == ["block", "block", "allow", "allow", "block", "block", "block"]
    assert [(rows[i].rule, rows[i].verdict) for i in (4, 5, 6, 7)] == [("example.net/en/", "allow"), ("net/", "block"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    assert rows[8].rule is None and rows[12].rule is None and (rows[4].host, rows[4].path) == ("x.example.net", "/en/9")
    assert all((rows[i].host, rows[i].path) == ("", "") for i in (9, 10, 11))
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


# --- neighbours ---------------------------------------------------------------------------------------------------


def test_hilbert_neighbours_touch():
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side, indexing="ij"), -1).reshape(-1, 3)
    order = cells[np.argsort(ann.hilbert_keys(cells, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def exact_neighbours(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ok = list({(i, tuple(v)): (i, v) for i, v in ok}.values())
    out = {}
    for i, q in ok:
        if i % 20 == 0:
            found = sorted((-float(np.cumsum(q * v)[-1]), j) for j, v in ok if j != i)
            out[i] = [j for _, j in found[:k]]
    return out


def test_neighbours(spark):
    draw = np.random.default_rng(9)
    rows = [(i, draw.normal(size=6).astype(np.float32).tolist()) for i in range(300)]
    rows += [(400 + i, [1.0, 2.0, 0.5, 0.0, 0.0, 1.0]) for i in range(60)]  # copies, more than k
    rows += [(500, None), (520, [0.0] * 6), (540, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (560, [float("nan")] * 6), (580, [float("inf")] * 6), (600, [1.0, 2.0]), (None, [1.0] * 6), rows[20], (40, rows[41][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit(1))
    got = defaultdict(list)
    for r in ann.nearest(table, k=5).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    want = exact_neighbours([r for r in rows if r[1] is None or len(r[1]) == 6], 5)
    for q, ids in want.items():
        if q != 40:  # one id with two vectors has a list for each
            assert got[q] == ids, q
    assert set(got) == set(want)
    assert ann.nearest(table.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.rank) for r in ann.nearest(few).collect()] == [(1, 1)]


def test_equal_scores_go_to_the_smaller_ids(spark):
    """Small-integer vectors: far more equal scores at the last place than a list has places."""
    draw = np.random.default_rng(21)
    vectors = sorted({tuple(v) for v in draw.integers(0, 2, (900, 12)).tolist() if any(v)})
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(draw.permutation(len(vectors)), vectors)]
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=5).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got == exact_neighbours(rows, 5)


def test_recall_with_small_windows(spark):
    """Fixed windows over more vectors than they cover still find nine of ten clustered neighbours."""
    draw = np.random.default_rng(12)
    centers = draw.normal(size=(40, 16))
    x = (centers[draw.integers(0, 40, 4000)] + 0.25 * draw.normal(size=(4000, 16))).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in ann.nearest(table, k=10, window=128).collect():
        got[r.query_id].add(r.vec_id)
    s = x[::20].astype(float) @ x.T.astype(float)
    s[np.arange(200), np.arange(0, 4000, 20)] = -np.inf
    best = np.argsort(-s, axis=1)[:, :10]
    assert np.mean([len(got[20 * i] & set(b.tolist())) / 10 for i, b in enumerate(best)]) >= 0.9


def test_recall_raises_the_window(spark):
    """Vectors without structure: fixed windows of 16 miss most neighbours, measured recall widens them."""
    x = np.random.default_rng(13).normal(size=(3000, 24)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    s = x[::20].astype(float) @ x.T.astype(float)
    s[np.arange(150), np.arange(0, 3000, 20)] = -np.inf
    best = np.argsort(-s, axis=1)[:, :10]
    found = {}
    for recall in (None, 0.9):
        got = defaultdict(set)
        for r in ann.nearest(table, k=10, window=16, recall=recall).collect():
            got[r.query_id].add(r.vec_id)
        found[recall] = np.mean([len(got[20 * i] & set(b.tolist())) / 10 for i, b in enumerate(best)])
    assert found[None] < 0.8 and found[0.9] >= 0.9


def test_more_levels_of_the_tree_compile_no_more_code(spark):
    """Cuts and goals are data of the plans: the driver keeps what it has compiled for the first levels."""
    table = docs(spark, [(i, f"word {i % 7} " * (1 + i % 31), None) for i in range(400)])
    compiled = spark._jvm.org.apache.spark.metrics.source.CodegenMetrics.METRIC_COMPILATION_TIME()

    def spent(shards):
        before = compiled.getCount()
        kd_shards.kd_shards(table, shards).select("shard").collect()
        return compiled.getCount() - before

    spent(4)
    few, many = spent(5), spent(48)
    print("classes compiled", few, many)
    assert many <= few + 30
