"""WARC archives: writing, reading, and revisit resolution into deduplicated archives.

Archives are written by Spark's own text writer, as gzip files whose rows are whole records, so
the commit protocol keeps them whole when executors are lost. They are read as binary files and
parsed by Content-Length, one record at a time.

Resolution moves headers alone: counts and the largest id are found for each digest with partial
aggregation, digests that occur once drop out, and only revisits go on to meet the bodies.

Defined results: a null payload is empty; a null URL has no target header; control characters and
spaces in a URL are percent-encoded; a null id is the smallest and is carried by no header; rows
that repeat id and payload are all responses, or all revisits of the same response; an empty table
gives empty archives; further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import Scratch

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HEADERS = "page_id long, target_uri string, warc_type string, payload_digest string, payload_bytes long, refers_to long"


def digest(payload: Column) -> Column:
    """Base32 SHA-1, upper case, of a binary column."""
    code = F.sha1(payload)
    letters = []
    for i in range(0, 40, 5):
        v = F.conv(F.substring(code, i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _uri(url: Column) -> Column:
    bad = {" ": "%20", "\t": "%09", "\r": "%0D", "\n": "%0A"}
    for c, code in bad.items():
        url = F.replace(url, F.lit(c), F.lit(code))
    return F.regexp_replace(url, r"[\x00-\x1f\x7f]", "%3F")


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _urn(page_id: Column, payload_digest: Column, kind: str) -> Column:
    """A record's id: a UUID made from a hash of what names it, so that a task run again gives the same."""
    h = F.md5(F.concat_ws("\x1f", F.lit(kind), F.coalesce(page_id.cast("string"), F.lit("none")), payload_digest).cast("binary"))
    part = lambda at, n: F.substring(h, at, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-3"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def record(page_id: Column, url: Column, payload: Column, size: Column, payload_digest: Column, refers_to: Column, date: str, kind: str, refers_to_url: Column | None = None) -> Column:
    """One WARC/1.1 record: a response, or a revisit where there is no payload; bytes as a string."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(END))
    revisit = payload.isNull()
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), F.lit("\r\n"),
        _line("WARC-Record-ID", _urn(page_id, payload_digest, kind)),
        F.lit(f"WARC-Date: {date}\r\n"),
        _line("WARC-Target-URI", _uri(url)),
        _line("WARC-X-Page-Id", page_id.cast("string")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), payload_digest)),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\n"), _line("WARC-Refers-To", _urn(refers_to, payload_digest, kind)), _line("WARC-Refers-To-Target-URI", _uri(F.lit(None).cast("string") if refers_to_url is None else refers_to_url)), F.lit(f"WARC-Refers-To-Date: {date}\r\n"), _line("WARC-X-Refers-To-Page-Id", refers_to.cast("string")))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.coalesce(F.octet_length(payload), F.lit(0))).cast("string"), F.lit(END),
        http, F.coalesce(payload.cast("string"), F.lit("")),
    )


def write_warc(records: DataFrame, path: str) -> None:
    """``records``: one column of whole records. Each part file is a gzip archive."""
    records.write.option("lineSep", END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def parse(raw: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, by lower-case name, and block of each record of one uncompressed stream."""
    while line := raw.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a record: {line[:80]!r}")
        headers = {}
        while (line := raw.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.partition(b":")
            headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
        size = int(headers["content-length"])
        block = raw.read(size)
        if len(block) != size:
            raise ValueError("a record ends before its Content-Length")
        yield headers, block


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Response and revisit records. Length and digest of a response are measured on its payload; a
    revisit has those that its headers name."""
    schema = HEADERS + (", payload binary" if payloads else "")
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()] + [pa.binary()] * payloads
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(content: bytes) -> Iterator[tuple]:
        raw = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
        for headers, block in parse(io.BufferedReader(raw, 1 << 18)):
            kind = headers.get("warc-type")
            if kind not in ("response", "revisit"):
                continue
            head, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
            if kind == "response":
                size, code, body = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), payload
            else:
                lengths = [x.partition(b":")[2] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                size, body = int(lengths[0]) if lengths else None, None
                code = headers.get("warc-payload-digest", "").rpartition(":")[2] or None
            row = (_number(headers.get("warc-x-page-id")), headers.get("warc-target-uri"), kind, code, size, _number(headers.get("warc-x-refers-to-page-id")))
            yield row + (body,) * payloads

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = lambda some: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names)
        for b in batches:
            for content in b.column(0):
                some: list[tuple] = []
                size = 0
                for r in rows(content.as_py()):
                    some.append(r)
                    size += len(r[-1] or b"") if payloads else 100
                    if size > 4_000_000:
                        yield batch(some)
                        some, size = [], 0
                if some:
                    yield batch(some)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, schema)


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Revisits among headers of responses: ``page_id, payload_digest, refers_to, refers_to_url``, once each.

    Of equal payloads the largest id is the response. ``headers`` is read twice.
    """
    whole = headers.where(F.col("payload_bytes") >= min_bytes)
    originals = whole.groupBy(F.col("payload_digest").alias("of_digest")).agg(F.max("page_id").alias("refers_to"), F.max_by("target_uri", F.struct("page_id", "target_uri")).alias("refers_to_url"), F.count("*").alias("n")).where("n > 1")
    met = whole.join(originals, F.col("payload_digest") == F.col("of_digest")).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return met.select("page_id", "payload_digest", "refers_to", "refers_to_url").distinct()


def deduplicated_archives(spark: SparkSession, pages: DataFrame, *, min_bytes: int = 0, date: str | None = None) -> DataFrame:
    """Archive ``pages``, resolve repeated payloads, write archives with revisits and read them back.

    ``date`` stands in all records; where it is not given, the time of the call does.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    scratch = Scratch(spark)
    first, second = scratch.path("archive"), scratch.path("deduplicated")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    none = F.lit(None).cast("long")
    write_warc(p.select(record(F.col("page_id"), F.col("url"), F.col("payload"), F.octet_length("payload"), digest(F.col("payload")), none, date, "crawl")), first)
    headers = scratch.cut(read_warc(spark, first).select("page_id", "target_uri", "payload_digest", "payload_bytes"), "headers")
    revisits = scratch.cut(resolve(headers, min_bytes).withColumnsRenamed({"page_id": "of_page", "payload_digest": "of_digest"}), "revisits")
    bodies = read_warc(spark, first, payloads=True).drop("refers_to")
    joined = bodies.join(revisits, F.col("page_id").eqNullSafe(F.col("of_page")) & (F.col("payload_digest") == F.col("of_digest")), "left")
    kept = F.when(F.col("of_digest").isNull(), F.col("payload"))
    write_warc(joined.select(record(F.col("page_id"), F.col("target_uri"), kept, F.col("payload_bytes"), F.col("payload_digest"), F.col("refers_to"), date, "deduplicated", F.col("refers_to_url"))), second)
    scratch.drop(headers, revisits)
    return read_warc(spark, second).select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to")
