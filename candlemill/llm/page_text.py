"""Main text of web pages by nearest-URL page differencing.

A page is cut into lines, one per block of its markup. Inside a host pages are ordered by URL path; a page is aligned with the
nearest pages of other content by a longest common subsequence of its lines, and the lines they share are template lines,
which go. Lines inside a page's own content container (``article``, ``main`` and their like) anchor the alignment but stay: two
articles may quote the same passage. What pages do not share but mark as furniture (menus, adverts, forms, reader comments)
goes by its mark.

Only hashes of lines are shuffled. Order and neighbours come from a range-partitioned numbering with halo chunks, so a
host with a third of all pages is spread over all tasks.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from candlemill.functions.windows import over_halo
from candlemill.llm.columns import pack, unpack
from candlemill.llm.text_arrays import release
from candlemill.sources.series import number_series, written

REACH = 3  # pages looked at on each side
CHUNK = 256  # pages of a host that are windowed together
COPY = 0.8  # a partner with this share of equal lines on both sides is a copy and shows no template
TABLE_BITS = 1 << 24  # alignments beyond it are split
BROADCAST_ROWS = 200_000

# Element names of HTML and words that sites use in class and id attributes.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template iframe object svg math canvas head title textarea select button audio video".split())
FURNITURE = frozenset("nav aside footer form menu dialog".split())
PLACED = FURNITURE | {"header", "article", "main"}
MARKED = frozenset(
    "ad ads adbox advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer discussion disqus "
    "footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup promo promotion "
    "recommended recommendations related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola teaser toolbar "
    "topbar widget widgets".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
CONTENT = frozenset("articlebody article-body article-content entry-content post-content post-body story-body main-content maincontent".split())
MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
CLOSERS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in ("script", "style", "textarea", "title", "noscript", "iframe")}


@dataclass(slots=True)
class Line:
    text: str
    zone: int  # 2 inside a content container, 1 elsewhere, 0 marked as furniture
    linked: int  # characters inside links


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(text)} if "=" in text or "hidden" in text else {}


def _mark(name: str, given: dict[str, str], inside: bool) -> int:
    """0 for furniture, 2 for a content container, 1 otherwise."""
    words = f"{given.get('class', '')} {given.get('id', '')}".split()
    if name in FURNITURE or (name == "header" and not inside) or given.get("role") in ROLES:
        return 0
    if "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", ""):
        return 0
    parts = {p for w in words for p in re.split("[-_]+", w)}
    if parts & MARKED and name not in ("html", "body"):
        return 0
    if name in ("article", "main") or given.get("role") in ("main", "article") or given.get("itemprop") == "articlebody" or CONTENT & set(words):
        return 2
    return 1


def page_lines(markup: str) -> list[Line]:
    """The lines of a page in order, one per block of text: white space as one space, character references decoded."""
    lines: list[Line] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements and the zone inside them
    depth: dict[str, int] = {}
    zone, linked, link, at, n = 1, 0, False, 0, len(markup)

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                lines.append(Line(text, zone, linked))
            held.clear()
        linked = 0

    def close(name: str) -> None:
        nonlocal zone
        if depth.get(name):
            while True:
                last, _ = stack.pop()
                depth[last] -= 1
                if last == name:
                    break
            zone = stack[-1][1] if stack else 1

    while at < n:
        tag = markup.find("<", at)
        if tag < 0:
            tag = n
        if tag > at:
            held.append(markup[at:tag])
            linked += tag - at if link else 0
        if tag == n:
            break
        found = MARKUP.match(markup, tag)
        if not found:  # a bare "<" is text
            held.append("<")
            at = tag + 1
            continue
        at = found.end()
        slash, name, rest = found.group(1, 2, 3)
        if name is None:
            slash, name, rest = found.group(4, 5, 6)
        if name is None:
            continue
        name = name.lower()
        if slash:
            if name == "a":
                link = False
            elif name in BLOCKS:
                flush()
            close(name)
            continue
        if name in CLOSERS:
            end = CLOSERS[name].search(markup, at)
            at = end.start() if end else n
            continue
        if name == "a":
            link = True
        elif name in ("br", "wbr"):
            held.append(" " if name == "br" else "")
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in BLOCKS:
            flush()
            if depth.get("p") and stack[-1][0] == "p":
                close("p")
            if name == "li" and depth.get("li") and stack[-1][0] == "li":
                close("li")
            mark = _mark(name, _attributes(rest), zone == 2) if rest or name in PLACED else 1
            if name in ("article", "main") and mark == 2:
                # an element that was never closed does not hold the article
                while zone == 0 and stack and stack[-1][0] in FURNITURE | {"header", "p", "li", "ul", "ol"}:
                    close(stack[-1][0])
            stack.append((name, 0 if zone == 0 or mark == 0 else max(zone, mark)))
        elif name in SILENT:
            stack.append((name, 0))
        elif rest:
            mark = _mark(name, _attributes(rest), zone == 2)
            if mark == 1:
                continue
            flush()
            stack.append((name, 0 if zone == 0 or mark == 0 else 2))
        else:
            continue
        depth[name] = depth.get(name, 0) + 1
        zone = stack[-1][1]
    flush()
    return lines


def main_text(lines: list[Line], shared: set[int]) -> str:
    """The lines that are neither furniture nor ``shared``: those of the content container, or of the page if it has none."""
    inside = [x.text for x in lines if x.zone == 2]
    if not inside:
        inside = [x.text for i, x in enumerate(lines) if x.zone == 1 and i not in shared and 2 * x.linked < len(x.text)]
    return "\n\n".join(inside)


def _rows_of(a: list[int], b: list[int]) -> list[int]:
    """Bit rows of the common-subsequence table of ``a`` (bits) and ``b`` (rows): a zero bit is a step up."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, rows = full, [full]
    for x in b:
        hit = v & places.get(x, 0)
        v = ((v + hit) | (v - hit)) & full
        rows.append(v)
    return rows


def _last_row(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``b`` with every beginning of ``a``."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for x in b:
        hit = v & places.get(x, 0)
        v = ((v + hit) | (v - hit)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes((len(a) + 7) // 8, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.concatenate(([0], np.cumsum(bits == 0)))


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of one longest common subsequence with ``b``, by bit rows; large tables are halved."""
    low, end_a, end_b = 0, len(a), len(b)
    while low < min(end_a, end_b) and a[low] == b[low]:
        low += 1
    tail = 0
    while tail < min(end_a, end_b) - low and a[end_a - 1 - tail] == b[end_b - 1 - tail]:
        tail += 1
    out = list(range(low)) + list(range(end_a - tail, end_a))
    mid_a, mid_b = a[low : end_a - tail], b[low : end_b - tail]
    both = set(mid_a) & set(mid_b)
    at = [i for i, x in enumerate(mid_a) if x in both]
    a2, b2 = [mid_a[i] for i in at], [x for x in mid_b if x in both]
    if not a2:
        return sorted(out)
    if len(a2) * len(b2) > TABLE_BITS and len(b2) > 1:
        half = len(b2) // 2
        left, right = _last_row(a2, b2[:half]), _last_row(a2[::-1], b2[half:][::-1])
        cut = int(np.argmax(left + right[::-1]))
        got = common_lines(a2[:cut], b2[:half]) + [cut + i for i in common_lines(a2[cut:], b2[half:])]
    else:
        rows, i, j, got = _rows_of(a2, b2), len(a2), len(b2), []
        while i and j:
            if rows[j] >> (i - 1) & 1:  # no step at i: the last line of a is not needed
                i -= 1
            elif not rows[j - 1] >> (i - 1) & 1:  # the step was there without the last line of b
                j -= 1
            else:
                got.append(i - 1)
                i, j = i - 1, j - 1
    return sorted(out + [low + at[i] for i in got])


_CUT = pa.schema([("digest", pa.string()), ("host", pa.string()), ("path", pa.string()), ("lines", pa.list_(pa.int64())), ("open", pa.bool_())])


def _cut_pages(pages: DataFrame) -> DataFrame:
    """Per page its host, path and the hashes of its lines; ``open`` where no content container holds the text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, host, path, markup in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                lines = page_lines(markup)
                rows.append({"digest": digest, "host": host, "path": path, "lines": [_hash(x.text) for x in lines], "open": not any(x.zone == 2 for x in lines)})
            yield pa.RecordBatch.from_pylist(rows, _CUT)
        release()

    return pages.mapInArrow(cut, "digest string, host string, path string, lines array<long>, open boolean")


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def shared_lines(own: list[int], others: list[tuple[list[int], int]]) -> list[int]:
    """Positions of the lines of ``own`` shared with its nearest partner of other content on each side.

    ``others`` are (lines, side) from near to far. A partner that shares most lines of both pages is a copy and is passed over.
    """
    found: set[int] = set()
    done: set[int] = set()
    for lines, side in others:
        if side in done or not lines:
            continue
        got = common_lines(own, lines)
        if len(got) >= COPY * len(own) and len(got) >= COPY * len(lines):
            continue
        done.add(side)
        found.update(got)
    return sorted(found)


def template_lines(pages: DataFrame) -> DataFrame:
    """``host``, ``digest``, ``shared``: positions of the lines that pages without a content container share with near pages.

    ``pages`` has ``digest``, ``host``, ``path``, ``html``. Equal pages of a host stand once, at their smallest path.
    """
    cut = _cut_pages(pages).groupBy("host", "digest").agg(F.min("path").alias("path"), F.first("lines").alias("lines"), F.first("open").alias("open"))
    placed = number_series(cut, "host", ["path", "digest"], step="place")

    def near(w):
        return {f"_{side}{k}": f("lines", k).over(w) for side, f in (("b", F.lag), ("f", F.lead)) for k in range(1, REACH + 1)}

    beside = over_halo(placed, REACH, near, ahead=REACH, run=("host",), index="place", chunk=CHUNK)
    order = [(f"_{side}{k}", side) for k in range(1, REACH + 1) for side in "bf"]
    beside = beside.filter("open").select("host", "digest", "lines", *[c for c, _ in order])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, digest, lines, *others = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            got = [shared_lines(own, [(o[i], side) for o, (_, side) in zip(others, order) if o[i] is not None]) for i, own in enumerate(lines)]
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(digest, pa.string()), pa.array(got, pa.list_(pa.int32()))], names=["host", "digest", "shared"])

    return beside.mapInArrow(align, "host string, digest string, shared array<int>").filter(F.size("shared") > 0)


def extract_text(pages: DataFrame, *, url: str = "url", html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text of every page in ``text``; all other columns stay.

    Null pages are empty and give an empty text, as do pages of nothing but furniture. A null url, or one without a host, counts
    to the host of the empty name. Pages of any length are read whole. Repeated pages get equal texts. A column of the name of
    ``text`` is replaced, others of any name are kept. Empty tables give no rows.
    """
    link = F.coalesce(F.col(url), F.lit(""))
    host = F.lower(F.regexp_extract(link, r"(?s)://([^/?#]*)", 1))
    path = F.regexp_extract(link, r"(?s)://[^/?#]*(.*)", 1)
    markup = F.coalesce(F.col(html), F.lit(""))
    shared = written(template_lines(pages.select(F.md5(markup.cast("binary")).alias("digest"), host.alias("host"), path.alias("path"), markup.alias("html"))), "page-templates")
    if shared.agg(F.count(F.lit(1)), F.sum(F.size("shared"))).filter(f"`count(1)` <= {BROADCAST_ROWS} AND `sum(size(shared))` <= {10 * BROADCAST_ROWS}").head(1):
        shared = F.broadcast(shared)
    rows = pack(pages, host=host, digest=F.md5(markup.cast("binary")), html=markup).join(shared, ["host", "digest"], "left")

    @F.arrow_udf("string")
    def kept(markup: pa.Array, shared: pa.Array) -> pa.Array:
        out = [main_text(page_lines(m), set(s or ())) for m, s in zip(markup.to_pylist(), shared.to_pylist())]
        release()
        return pa.array(out, pa.string())

    return unpack(rows.withColumn("_text", kept("html", "shared")), pages.columns, **{text: F.col("_text")})
