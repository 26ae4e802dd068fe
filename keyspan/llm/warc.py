"""WARC archives with revisit resolution.

``write_archives`` shuffles record headers by payload digest, makes every record but one of an equal payload a revisit
of that one, and writes WARC/1.1 records with fresh headers. The text writer with the line separator CR LF CR LF ends
each record as the format asks, so that archives are written through Spark's own commit protocol to any file system
it knows. Archives are compressed with gzip, a member a file (that writer cannot start one a record, so a reader can't
seek in them). Revisits name the record, address and date they refer to. ``read_archives`` reads them, compressed or not, by Content-Length, never
by separators. ``resolve_revisits`` joins revisit
records to the responses they refer to.

Edge cases: a null payload is empty; a null url has no WARC-Target-URI; control characters in a url are percent-encoded.
A record with a null id is always a response and is never referred to. Rows that repeat the id of the response are
responses too; of several urls of that id the last in text order is referred to. An empty table makes archives without records. Extra columns are not archived.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import if_small, salt_of, salted, scratch, stored

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Payloads of fewer bytes are stored again each time: a revisit record would save nothing.
LEAST_BYTES = 1000
#: Bytes an archive file should have.
FILE_BYTES = 32 << 20


def _header(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def _clean(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A"), r"[\x00-\x1f\x7f]", "%20")


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def decide(pages: DataFrame, page_id: str, url: str, payload: str, least_bytes: int) -> DataFrame:
    """page_id, url, payload, digest, bytes, refers_to (the response's id for a revisit, else null) and its refers_url.

    Only headers are shuffled by digest. What was decided comes back to the pages by id and digest, as a broadcast if a
    count shows that the revisits are few."""
    body = F.coalesce(pages[payload].cast("string"), F.lit(""))
    base = pages.select(pages[page_id].cast("bigint").alias("page_id"), pages[url].cast("string").alias("url"), body.alias("payload"))
    base = base.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("bigint"))
    heads = stored(base.where((F.col("bytes") >= least_bytes) & F.col("page_id").isNotNull()).select("digest", "page_id", "url"), "heads")
    groups = heads.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("response"), F.count("*").alias("n")).where("n > 1").select("digest", "response")
    keyed = heads.select("digest", "page_id", salt_of("page_id"))
    found = keyed.join(salted(groups), ["digest", "__salt"]).where("page_id < response.page_id")
    found = found.select("digest", "page_id", F.col("response.page_id").alias("refers_to"), F.col("response.url").alias("refers_url")).distinct()
    revisits = if_small(stored(found, "revisits"))
    return base.join(revisits, ["digest", "page_id"], "left").select("page_id", "url", "payload", "digest", "bytes", "refers_to", "refers_url")


def write_archives(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = LEAST_BYTES) -> None:
    mean = pages.agg(F.avg(F.coalesce(F.octet_length(pages[payload].cast("string")), F.lit(0)))).first()[0] or 0
    per_file = max(1, int(FILE_BYTES / (mean + 600)))
    d = decide(pages, page_id, url, payload, least_bytes)


    def record_id(own_id: str, own_url: str) -> Column:
        return _uuid(F.lit("record"), F.coalesce(F.col(own_id).cast("string"), F.lit("null")), F.coalesce(own_url, F.lit("")), F.col("digest"))

    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    is_revisit = F.col("refers_to").isNotNull()
    block = F.when(is_revisit, http).otherwise(F.concat(http, F.col("payload")))
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(is_revisit, "revisit").otherwise("response"), F.lit(CRLF),
        _header("WARC-Record-ID", record_id("page_id", "url")),
        _header("WARC-Date", F.lit(DATE)),
        _header("WARC-Target-URI", _clean(F.col("url"))),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(is_revisit, F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}")).otherwise(""),
        _header("WARC-Refers-To", F.when(is_revisit, record_id("refers_to", "refers_url"))),
        _header("WARC-Refers-To-Target-URI", F.when(is_revisit, _clean(F.col("refers_url")))),
        _header("WARC-Refers-To-Date", F.when(is_revisit, F.lit(DATE))),
        _header("X-Page-Id", F.col("page_id")),
        _header("X-Refers-To-Page-Id", F.col("refers_to")),
        F.lit(f"Content-Type: application/http;msgtype=response{CRLF}"),
        _header("Content-Length", F.octet_length(block)),
        F.lit(CRLF), block,
    )
    d.select(record.alias("value")).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path)


def records(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Headers and block of each record of an archive."""
    at, end = 0, len(data)
    while at < end:
        head_end = data.index(b"\r\n\r\n", at)
        lines = data[at:head_end].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
        start = head_end + 4
        stop = start + int(headers[b"content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut off")
        yield headers, data[start:stop]
        at = stop + 4


RECORD = "page_id bigint, url string, record_type string, digest string, payload_bytes bigint, refers_to bigint, payload binary"


def read_archives(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """A row a record; digest and bytes of a response are computed from the stored payload, those of a revisit are the header's and null."""

    def number(x: bytes | None) -> int | None:
        return None if x is None else int(x)

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                rows = []
                for h, block in records(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content):
                    kind = h[b"warc-type"].decode()
                    payload = block.partition(b"\r\n\r\n")[2]
                    digest = hashlib.sha1(payload).hexdigest() if kind == "response" else re.sub("^sha1:", "", h[b"warc-payload-digest"].decode())
                    uri = h.get(b"warc-target-uri")
                    rows.append((number(h.get(b"x-page-id")), uri and uri.decode(), kind, digest, len(payload) if kind == "response" else None, number(h.get(b"x-refers-to-page-id")), payload if with_payload else None))
                    if len(rows) == 2000:
                        yield frame_of(rows)
                        rows = []
                yield frame_of(rows)

    def frame_of(rows: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")], dtype=object)
        return out.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(parse, RECORD)


def resolve_revisits(archived: DataFrame) -> DataFrame:
    """Records without payload columns; a revisit has the bytes of the response with its digest."""
    rows = archived.select("page_id", "url", "record_type", "digest", "payload_bytes", "refers_to")
    asked = rows.where("record_type = 'revisit'")
    originals = rows.where("record_type = 'response'").groupBy("digest").agg(F.max("payload_bytes").alias("__bytes"))
    found = asked.drop("payload_bytes").withColumn("__salt", salt_of("page_id")).join(salted(originals), ["digest", "__salt"], "left")
    found = found.select("page_id", "url", "record_type", "digest", F.col("__bytes").alias("payload_bytes"), "refers_to")
    return rows.where("record_type <> 'revisit'").unionByName(found)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    back = resolve_revisits(read_archives(spark, path, with_payload=False))
    return back.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM m
"""
