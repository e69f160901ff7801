"""Ranked search, page text and spelling variants on small tables against brute force."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlemill.llm import dense_rank, page_text, variants

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
EXTRA = {"_row": 1, "uid": 2, "n": 3, "term": 4, "host": 5, "digest": 6, "shared": 7, "word": 8, "rank": 9, "score": 10}


def extra(df):
    return df.withColumns({k: F.lit(v) for k, v in EXTRA.items()})


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- ranked search ------------------------------------------------------------------------------------------------


def brute_rank(docs, items, k=20):
    held = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            n = sum(c.values())
            m = 75 + 25 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in TERM.findall(lower(text)) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


LONG = " ".join(f"w{i % 977} x{i % 13}." for i in range(40_000))
DOCS = [
    (1, "The cat sat; the mat. Ünder ß1 2a"), (2, "CAT cat cat dog"), (3, None), (4, ""), (5, " ;;\x7f "), (6, "dog-dog_dog"), (None, "cat dog"), (7, LONG), (8, LONG + " cat"),
    (2, "CAT cat cat dog"), (9, "mat mat mat 2a ünder"), (10, "x" * 100_000 + " cat"),
] + [(100 + i, "same words tie here") for i in range(60)]
ITEMS = [(1, "cat dog cat"), (2, None), (3, ""), (4, "same tie"), (1, "mat Ünder 2A"), (5, "never-seen unheard"), (None, "w3 x5 cat"), (6, "the " * 5000), (7, LONG)]


def test_ranked_search_like_brute_force(spark):
    docs = extra(spark.createDataFrame(DOCS, "doc_id long, text string")).repartition(5)
    items = extra(spark.createDataFrame(ITEMS, "item_id long, text string"))
    got = [tuple(r) for r in dense_rank.rank_documents(docs, items).collect()]
    assert sorted(got, key=repr) == brute_rank(DOCS, ITEMS)


def test_ranked_search_in_small_tiles_and_groups(spark, monkeypatch):
    monkeypatch.setattr(dense_rank, "GROUP_BYTES", 40)
    monkeypatch.setattr(dense_rank, "MOST_BYTES", 60)
    docs, items = DOCS[:6] + DOCS[10:], ITEMS[:7]
    got = dense_rank.rank_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=3)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_rank(docs, items, 3)


def test_weight_tiles_stay_exact_beyond_2_to_the_53():
    rng = np.random.default_rng(1)
    items, terms = rng.integers(0, 3, 40), rng.permutation(40)
    weights = rng.integers(1, 1 << 35, 40)
    tiles = dense_rank.weight_tiles(items, terms, weights, 3)
    assert len(tiles) > 2 and all(t.sum(axis=1).max() * dense_rank.IMPACT <= dense_rank.EXACT for _, t in tiles)
    total = np.zeros((3, 40), object)
    for at, tile in tiles:
        for j, t in enumerate(at):
            total[:, t] += tile[:, j].astype(np.int64)
    want = np.zeros((3, 40), object)
    for i, t, w in zip(items, terms, weights):
        want[i, t] += int(w)
    assert (total == want).all()


def test_ranked_search_of_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(DOCS[:3], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS[:2], "item_id long, text string")
    for d, i in ((none, items), (some, items.filter("false")), (none, items.filter("false"))):
        assert dense_rank.rank_documents(d, i).collect() == []


# --- page text ----------------------------------------------------------------------------------------------------


def brute_lcs(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    return table[-1, -1]


@pytest.mark.parametrize("bits", [4, 1 << 24])
def test_common_lines_are_a_longest_common_subsequence(bits, monkeypatch):
    monkeypatch.setattr(page_text, "TABLE_BITS", bits)
    rng = np.random.default_rng(bits)
    for _ in range(400):
        a, b = rng.integers(0, 5, rng.integers(0, 15)).tolist(), rng.integers(0, 5, rng.integers(0, 15)).tolist()
        got = page_text.common_lines(a, b)
        rest = iter(b)
        assert len(set(got)) == len(got) == brute_lcs(a, b) and all(a[i] in rest for i in got)


@pytest.mark.parametrize("markup, text", [
    ("", ""), ("plain", "plain"), ("a &lt; b &amp;amp; &#x41;&eacute;&nbsp;c &copy", "a < b &amp; Aé c ©"),
    ("<p>one<br>two\n\t three<p>four <b>bold</i> x</p>", "one two three\n\nfour bold x"),
    ("<nav><ul><li>menu<article><h1>T</h1><p>body<aside>side</aside>more</article>tail", "T\n\nbody\n\nmore"),
    ("<header>top</header><article><header><h1>H</h1></header><p>t</p><form><p>f</p></form><section class='user-comments'><article>no</article></section></article>", "H\n\nt"),
    ("<body><div class='cookie-notice'><p>ok?</p></div><div id=sidebar>s</div><div>words <a href=x>link</a> here</div><ul><li><a>only link</a></ul></body>", "words link here"),
    ("<main><p>kept</p><script>if(a<b){'</p>'}</script><style>p{}</style><textarea>typed</textarea><!-- c --><p hidden>h</p></main>", "kept"),
    ("<p", ""), ("<!-- open", ""), ("<article><p>5 < 6 > 4</article>", "5 < 6 > 4"), ("<div class=ad>buy</div><footer>f</footer>", ""),
])
def test_lines_of_a_page(markup, text):
    assert page_text.main_text(page_text.page_lines(markup), set()) == text


def pages_of_one_site():
    """Pages without marks: the template lines differ by section, the bodies are their own; some bodies are quoted and copied."""
    rows, want = [], {}
    for i in range(40):
        section = "ab"[i % 2]
        body = [f"Own line {i} of page {i * 7}.", "A passage that all pages of the even section hold as their own body does not." if i < 0 else f"Second own line {i}."]
        lines = [f"Site name {section}", f"Section {section} menu", *body, "All rights kept", f"Printed by {section}"]
        rows.append((i, f"http://h.example/{section}/{i:03d}", "".join(f"<div>{x}</div>" for x in lines)))
        want[i] = "\n\n".join(body)
    rows += [(50, "http://h.example/a/000x", rows[0][2]), (51, "http://h.example/a/000y", rows[0][2])]  # copies show no template
    want |= {50: want[0], 51: want[0]}
    rows += [(60, "http://other.example/a/000", rows[0][2])]  # alone on its host
    want[60] = "\n\n".join(re.findall("<div>(.*?)</div>", rows[0][2]))
    return rows, want


def test_template_lines_of_near_urls_go(spark):
    rows, want = pages_of_one_site()
    df = extra(spark.createDataFrame(rows, "page_id long, url string, html string")).repartition(4)
    out = page_text.extract_text(df)
    assert set(out.columns) == set(df.columns) | {"text"}
    got = out.collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r[k] == v for r in got for k, v in EXTRA.items())


def test_passages_shared_inside_articles_stay(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"http://h.example/{i:02d}", f"<nav>m</nav><article><h1>t{i}</h1><p>{passage}</p><p>same short line</p></article><footer>f</footer>") for i in range(12)]
    got = page_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"t{i}\n\n{passage}\n\nsame short line" for i in range(12)}


def test_page_text_of_odd_rows(spark):
    rows = [(1, None, None), (2, "no host", ""), (None, "http://h/x", "<p>a</p>"), (3, "http://h/y", "<p>" + "long " * 200_000 + "</p>"), (3, "http://h/y", None), (1, None, "<p>b</p>")]
    df = extra(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = sorted(((r.page_id, r.text) for r in page_text.extract_text(df).collect()), key=repr)
    assert got == sorted([(1, ""), (2, ""), (None, "a"), (3, " ".join(["long"] * 200_000)), (3, ""), (1, "b")], key=repr)
    assert page_text.extract_text(df.filter("false")).collect() == []


# --- spelling variants --------------------------------------------------------------------------------------------


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute_forms(words):
    out = {}
    for w, n in words.items():
        others = sorted((-m, v) for v, m in words.items() if near(w, v))
        fits = bool(others) and -others[0][0] >= 2 * n
        out[w] = [w, others[0][1] if fits else None, None, n, len(others), -others[0][0] if fits else None]
    for w, row in out.items():
        at = w
        while out[at][1] is not None:
            at = out[at][1]
        row[2] = at
    return {tuple(r) for r in out.values()}


def test_variants_like_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = {}
    for size, letters in ((400, "ab"), (300, "abcé"), (100, "a")):
        for _ in range(size):
            words["".join(rng.choice(list(letters), rng.integers(1, 9)))] = int(rng.integers(1, 50))
    long = "q" * 3000
    words |= {long: 40, long + "r": 3, long[:-1] + "z": 9, "z" + long: 1, long[:1500] + "x" + long[1500:]: 5}
    df = spark.createDataFrame([(w, n, 1) for w, n in words.items()], "word string, n long, near int")
    want = brute_forms(words)
    assert {tuple(r) for r in variants.variant_forms(df).collect()} == want
    monkeypatch.setattr(variants, "FEW_BRANCHES", 3)
    assert {tuple(r) for r in variants.variant_forms(df).collect()} == want


def test_variants_of_odd_rows(spark):
    df = spark.createDataFrame([("word", 1), ("word", 4), (None, 3), ("", 2), ("wordy", 2)], "word string, n long")
    assert {tuple(r) for r in variants.variant_forms(df).collect()} == {("word", None, "word", 5, 1, None), ("wordy", "word", "word", 2, 1, 5)}
    assert variants.variant_forms(df.filter("false")).collect() == []


def test_corpus_words(spark):
    text = "Straße STRASSE naïve×x÷y 12abc_def Àbcdé"
    rows = [(i, text, 1, 2) for i in range(400)] + [(None, text, 1, 2), (7, None, 1, 2), (8, "", 1, 2)]
    counts = Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, word int, n int")
    want = {(w, n) for w, n in counts.items() if len(w) >= 5 and n >= 3}
    assert {tuple(r) for r in variants.corpus_words(df).collect()} == want and len(want) > 4
