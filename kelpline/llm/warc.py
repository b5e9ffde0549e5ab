"""WARC archives with revisit records for repeated payloads.

Headers (key, digest, size) alone are shuffled by payload digest and find the record that each repetition
revisits; records are rendered with fresh headers and written through Spark's own writer, gzipped, so any
file system that Spark reaches will do. Reading back parses each archive by the length that each header states.
"""

from __future__ import annotations

import base64
import gzip
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_batches, salted_group_min, shared_dir, table

#: Payloads of fewer bytes are always written whole.
LEAST_BYTES = 0
#: Fixed date of the fresh headers, so that equal input gives equal archives.
DATE = "2024-01-31T00:00:00Z"
#: Most records of one archive file; a file is read back by one task.
FILE_RECORDS = 500
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@F.pandas_udf(T.StringType())
def _base32(hexes: pd.Series) -> pd.Series:
    return hexes.map(lambda h: base64.b32encode(bytes.fromhex(h)).decode(), na_action="ignore")


def resolve(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """headers (page_id, digest, size) plus refers_to: the smallest page_id of an equal payload, null for itself.

    Null ids never revisit nor are revisited; of rows that repeat an id and its payload, each is a response.
    """
    asked = headers.withColumn("__id", F.when((F.col("size") >= least_bytes), F.col("page_id")))
    known = salted_group_min(asked, ["digest", "size"], "__id", "__first", unique="page_id")
    refers = F.when(F.col("__id") != F.col("__first"), F.col("__first"))
    return known.withColumn("refers_to", refers).drop("__id", "__first")


def _urn(key: Column) -> Column:
    h = F.md5(F.concat(F.lit("record:"), key.cast("string")).cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def rendered(rows: DataFrame) -> DataFrame:
    """One column, record: a WARC record without the two line ends after its block.

    rows: page_id, url, payload (binary), digest, size, refers_to. A header line never holds line ends of a url.
    """
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))
    first = F.col("refers_to").isNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n")).cast("binary")
    block = F.concat(http, F.when(first, F.col("payload")).otherwise(F.lit(b"")))
    rows = rows.withColumn("block", block)
    url = F.regexp_replace("url", "[\\x00-\\x20\\x7f]", "%20")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(first, F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", _urn(F.coalesce(F.col("page_id").cast("string"), F.col("digest")))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Refers-To", F.when(~first, _urn(F.col("refers_to")))),
        line("WARC-Profile", F.when(~first, F.lit(PROFILE))),
        line("X-Page-Id", F.col("page_id").cast("string")),
        line("X-Refers-To-Page-Id", F.col("refers_to").cast("string")),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length("block").cast("string"),
        F.lit("\r\n\r\n"),
    )
    return rows.select(F.concat(head.cast("binary"), F.col("block")).cast("string").alias("record"))


def write(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Writes an archive record per row of pages (page_id, url, html; a null html is empty) under path.

    Equal payloads of at least least_bytes are stored once. Only (page_id, digest, size) is shuffled by
    digest; the payloads are shuffled once, by the row they belong to, and stay where they are if a page is a response.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    links = resolve(rows.select("page_id", "digest", "size").where("page_id is not null").distinct(), least_bytes)
    revisits = links.where("refers_to is not null").select("page_id", "digest", "size", "refers_to")
    joined = rows.join(revisits, ["page_id", "digest", "size"], "left").withColumn("digest", _base32("digest"))
    rendered(joined).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of an uncompressed archive's records, each block as long as its header says."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at byte {at}: {lines[0][:40]!r}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        length = int(headers["Content-Length"])
        yield headers, data[end + 4 : end + 4 + length]
        at = end + 4 + length
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"no end of record at byte {at}")
        at += 4


def read(spark: SparkSession, path: str) -> DataFrame:
    """The archives' records; a response's digest and size are those of the payload that was read."""
    import hashlib

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                out = []
                for headers, block in records(gzip.decompress(content)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind = headers["WARC-Type"]
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    if kind == "response":
                        digest, length = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                    page, refers = (headers.get(k) for k in ("X-Page-Id", "X-Refers-To-Page-Id"))
                    out.append((page, length, digest, kind, refers, headers.get("WARC-Target-URI")))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in RECORDS.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return by_batches(files.select("content"), parsed, RECORDS, ("page_id", "refers_to"))


def archived(pages: DataFrame) -> DataFrame:
    """Writes pages as archives in the shared folder and reads them back: a row per page.

    Null html is an empty payload, null ids and urls stay null (a null id is always a response); rows that
    repeat an id and payload are all responses (or revisits of the same page); an empty table gives no rows.
    """
    path = shared_dir(pages.sparkSession)
    write(pages, path)
    return read(pages.sparkSession, path)


def query(spark, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))
