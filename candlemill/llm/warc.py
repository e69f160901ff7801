"""WARC archives: writing captures, and transaction assembly on reading.

Writing makes three records per page: a request and a metadata record that are concurrent to the page's response (or
revisit) record. Equal payloads are stored once; later captures become revisits. The records are rows of one text
column whose line separator is the blank line that ends a WARC record, so Spark's text sink writes the archives with
its own commit protocol, to any store it can reach.

Reading takes the archives as binary files, each far smaller than a task's memory, finds records by Content-Length, and joins
request, response and metadata records through WARC-Concurrent-To into one nested row per capture.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from candlemill.sources.series import written

# Names of the WARC 1.1 format and the base32 alphabet.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"


def base32(digits: Column) -> Column:
    """Bare upper-case base32 of a SHA-1 given as 40 hex digits: 15 hex digits are 12 digits of base 32."""
    parts = [F.lpad(F.conv(F.substring(digits, at, n), 16, 32), n * 4 // 5, "0") for at, n in ((1, 15), (16, 15), (31, 10))]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def sha1_base32(text: Column) -> Column:
    return base32(F.sha1(text.cast("binary")))


def _uuid(seed: Column) -> Column:
    h = F.md5(seed)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def _record(kind: str | Column, record_id: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) for name, value in fields]
    head = F.concat(F.lit(f"{VERSION}\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: <urn:uuid:"), record_id, F.lit(">\r\n"))
    rest = [F.coalesce(x, F.lit("")) for x in lines]  # a null field is left out
    return F.concat(head, *rest, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def write_captures(
    pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", at_least: int = 0,
    date: str = "2024-01-01T00:00:00Z", records_per_file: int = 4096,
) -> None:
    """Write gzip archives of three records per row of ``pages``.

    Of rows with equal payloads of at least ``at_least`` bytes the one with the smallest id (null last; one of them
    among repeated rows) holds the payload as a response; the others are revisits of it. Null payloads are empty,
    null urls have no WARC-Target-URI, line breaks in urls are percent-encoded. An empty table writes no archive.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    link = F.regexp_replace(F.regexp_replace(F.col(url), "\r", "%0D"), "\n", "%0A")
    own = pages.select(F.col(page_id).cast("string").alias("page"), F.col(page_id).isNull().alias("no_page"), F.col(page_id).alias("page_id"), link.alias("url"),
                       F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"), F.uuid().alias("cid"))
    # Written once: the ids are random, and every record of a capture must carry the same ones.
    own = written(own, "warc-captures")
    least = F.min(F.struct("no_page", "page_id", "cid"))
    firsts = own.filter(F.col("bytes") >= at_least).groupBy("digest").agg(least.alias("first")).select("digest", F.col("first.cid").alias("first_cid"))
    own = own.alias("c").join(firsts.alias("f"), (F.col("c.digest") == F.col("f.digest")) & (F.col("c.bytes") >= at_least), "left").select(
        "c.*", F.when(F.col("f.first_cid") != F.col("c.cid"), F.col("f.first_cid")).alias("refers_to"))
    own = written(own, "warc-links")
    bodies = pages.select(F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("n"), payload.alias("html"))
    shared = bodies.filter(F.col("n") >= at_least).groupBy("digest").agg(F.first("html").alias("html"))
    shared = own.filter("refers_to IS NULL").filter(F.col("bytes") >= at_least).join(shared, "digest")
    responses = shared
    if at_least > 0:  # short payloads are never shared, and are as many as their rows
        short = pages.select(F.col(page_id).alias("page_id"), link.alias("url"), payload.alias("html"), F.uuid().alias("cid")).filter(F.octet_length("html") < at_least)
        short = short.select(F.col("page_id").cast("string").alias("page"), F.col("page_id").isNull().alias("no_page"), "page_id", "url",
                             F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").cast("long").alias("bytes"), "cid", F.lit(None).cast("string").alias("refers_to"), "html")
        short = written(short, "warc-short")
        responses = responses.select(*short.columns).unionByName(short)
        own = own.filter(F.col("bytes") >= at_least).unionByName(short.drop("html"))
    stamp, target = ("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest"))))
    together = ("WARC-Concurrent-To", F.concat(F.lit("<urn:uuid:"), F.col("cid"), F.lit(">")))
    http = ("Content-Type", F.lit("application/http;msgtype=response"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    main = responses.select(_record("response", F.col("cid"), [stamp, target, digest, http], F.concat(head, F.col("html"))).alias("value"))
    again = own.filter("refers_to IS NOT NULL").select(_record(
        "revisit", F.col("cid"), [stamp, target, digest, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), F.col("refers_to"), F.lit(">"))), http],
        head).alias("value"))
    place = F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), "(?s)://([^/?#]*)([^#]*)", 1), F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), "(?s)://([^/?#]*)([^#]*)", 2)
    ask = F.concat(F.lit("GET "), F.when(place[1] == "", F.lit("/")).otherwise(place[1]), F.lit(" HTTP/1.1\r\nHost: "), place[0], F.lit(END))
    request = _record("request", _uuid(F.concat("cid", F.lit("q"))), [stamp, target, together, ("Content-Type", F.lit("application/http;msgtype=request"))], ask)
    notes = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("page"), F.lit("\r\n")), F.lit("")), F.lit("payload-bytes: "), F.col("bytes").cast("string"), F.lit("\r\n"))
    metadata = _record("metadata", _uuid(F.concat("cid", F.lit("m"))), [stamp, target, together, ("Content-Type", F.lit("application/warc-fields"))], notes)
    beside = own.select(F.explode(F.array(request, metadata)).alias("value"))
    records = main.unionByName(again).unionByName(beside)
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a gzip archive, decompressed piece by piece."""
    view, at, buffer, state = memoryview(content), 0, bytearray(), zlib.decompressobj(31)

    def more() -> bool:
        nonlocal at, state
        while at < len(view) or state.unconsumed_tail:
            piece = view[at : at + (1 << 20)]
            at += len(piece)
            buffer.extend(state.decompress(bytes(piece)))
            if state.eof:  # next member
                at -= len(state.unused_data)
                state = zlib.decompressobj(31)
            if piece:
                return True
        return False

    while True:
        seen = 0
        while (end := buffer.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(buffer) - 3)
            if not more():
                if buffer.strip():
                    raise ValueError("an archive ends inside a record's header")
                return
        lines = bytes(buffer[:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins here: {lines[0][:80]!r}")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        size = int(fields["content-length"])
        while len(buffer) < end + 4 + size + 4:
            if not more():
                raise ValueError("an archive ends inside a record")
        yield fields, bytes(buffer[end + 4 : end + 4 + size])
        del buffer[: end + 4 + size + 4]


RECORDS = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("page_id", pa.int64()), ("request", pa.string()), ("payload", pa.binary())])
_DDL = "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, payload_digest string, payload_bytes long, page_id long, request string, payload binary"


def _bare(value: str | None) -> str | None:
    return value.removeprefix("<urn:uuid:").removesuffix(">") if value else None


def _row(fields: dict[str, str], block: bytes, payloads: bool) -> dict:
    kind = fields["warc-type"]
    row = dict.fromkeys(RECORDS.names) | {
        "record_id": _bare(fields["warc-record-id"]), "record_type": kind, "concurrent_to": _bare(fields.get("warc-concurrent-to")),
        "refers_to": _bare(fields.get("warc-refers-to")), "target_uri": fields.get("warc-target-uri")}
    said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if said and digest != said:
            raise ValueError(f"record {row['record_id']}: the payload does not have its digest")
        row |= {"payload_digest": digest, "payload_bytes": len(payload), "payload": payload if payloads else None}
    elif kind == "revisit":
        row["payload_digest"] = said
    elif kind == "request":
        row["request"] = block.decode()
    elif kind == "metadata":
        notes = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if x)
        row |= {"page_id": int(notes["page-id"]) if "page-id" in notes else None, "payload_bytes": int(notes["payload-bytes"])}
    return row


def read_records(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for fields, block in parse_archive(content.as_py()):
                    rows.append(_row(fields, block, payloads))
                    size += len(block)
                    if len(rows) >= 4096 or size > 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, RECORDS)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, RECORDS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(parse, _DDL)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit with the request and metadata records concurrent to it.

    ``records`` is read once: the three records of a capture meet in one grouping on the id they share. A capture without a
    request or metadata record keeps a null there, and records concurrent to nothing that is there go. Of repeated records of
    one kind the one with the smallest id counts. A revisit also names the page it refers to. No records give no rows.
    """
    own = ("record_id", "record_type", "refers_to", "target_uri", "payload_digest", "payload_bytes", "payload")
    kind = F.col("record_type")

    def least(wanted: Column, *fields: Column | str) -> Column:
        return F.min_by(F.when(wanted, F.struct(*fields)), F.when(wanted, F.col("record_id")))

    nested = records.groupBy(F.when(kind.isin("response", "revisit"), F.col("record_id")).otherwise(F.col("concurrent_to")).alias("capture")).agg(
        least(kind.isin("response", "revisit"), *own).alias("response"),
        least(kind == "request", F.col("record_id").alias("id"), "target_uri", "request").alias("request"),
        least(kind == "metadata", F.col("record_id").alias("id"), "page_id", "payload_bytes").alias("metadata"))
    nested = written(nested.filter("response IS NOT NULL").withColumnRenamed("capture", "record_id"), "warc-nested")
    pages = nested.select(F.col("record_id").alias("refers_id"), F.col("metadata.page_id").alias("refers_to_page"))
    return nested.withColumn("refers_id", F.col("response.refers_to")).join(pages, "refers_id", "left").drop("refers_id")
