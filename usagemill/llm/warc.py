"""WARC archives with revisit records for repeated payloads.

Headers (page_id, digest, length) are shuffled by payload digest. What they decide, the response of each payload that
occurs more than once, is joined with the pages by digest: broadcast, so that no html travels, if it is counted to be
small, else by a salted shuffle. Records are written as text, whose line separator is the blank line that ends a WARC record,
so any file system that Spark writes to will do.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from base64 import b32encode

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined_stats, passing, shared_dir, staged

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of payload in an archive file, whose compressed form a reader holds as a whole, unless a single one has more.
FILE_BYTES = 64 << 20
#: Payloads of up to so many bytes share files, FILE_BYTES / bound to a file; larger ones have a file each.
BOUNDS = (32 << 10, 1 << 20)
READ = "page_id long, uri string, record_type string, payload_digest string, payload_bytes long, refers_to long, intact boolean"


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: each five hex digits are four base32 digits."""
    bits = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(bits, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def responses(headers: DataFrame, least: int = 0) -> DataFrame:
    """(payload_digest, first): the smallest page_id of each payload of at least ``least`` bytes that occurs more than once.

    headers: (page_id, payload_digest, payload_bytes). Equal payloads are pre-aggregated before the shuffle.
    """
    first = headers.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    return first.where("n > 1 and first is not null").drop("n")


def _record_id(name: Column) -> Column:
    """A version-5-like UUID of a name."""
    h = F.sha1(name)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def records(pages: DataFrame, date: str, least: int = 0) -> DataFrame:
    """(value, payload_bytes): one WARC record for each page, fresh headers and all, without the blank line that ends it."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    uri = F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("about:blank")), r"[\x00-\x20\x7F]", "_")
    all_pages = pages.select(F.col("page_id").cast("long").alias("page_id"), uri.alias("uri"), html.alias("html"))
    size = F.octet_length("html").cast("long")
    heads = all_pages.select("page_id", payload_digest(F.col("html")).alias("payload_digest"), size.alias("payload_bytes"))
    first = staged(responses(heads, least), "responses")
    rows = joined_stats(all_pages.withColumn("payload_digest", payload_digest(F.col("html"))), first, "payload_digest", "left")
    # A row without page_id can't be referred to, but can refer.
    rows = rows.withColumn("refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")))
    by_page = lambda c: F.concat(F.lit("page:"), c.cast("string"))
    name = F.coalesce(by_page(F.col("page_id")), F.concat(F.lit("uri:"), "uri", F.lit(" "), "payload_digest"))
    number = F.coalesce(F.concat(F.lit("\r\nWARC-Page-ID: "), F.col("page_id").cast("string")), F.lit(""))
    revisit, line = F.col("refers_to").isNotNull(), F.lit("\r\n")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), _record_id(name), number,
        F.lit("\r\nWARC-Date: " + date + "\r\nWARC-Target-URI: "), F.col("uri"), F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"), line,
    )
    more = F.concat(F.lit("WARC-Profile: " + PROFILE + "\r\nWARC-Refers-To: "), _record_id(by_page(F.col("refers_to"))), F.lit("\r\nWARC-Refers-To-Page-ID: "), F.col("refers_to").cast("string"), F.lit("\r\nWARC-Refers-To-Date: " + date), line)
    block = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    tail = F.concat(F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)
    return rows.select(F.concat(head, F.when(revisit, more).otherwise(F.lit("")), tail).alias("value"), F.octet_length(block).alias("payload_bytes"))


def write(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least: int = 0, bounds: tuple = BOUNDS, file_bytes: int = FILE_BYTES) -> str:
    """Write gzipped archives in folders below path, one for each class of payload sizes, so that a file's bytes are bounded.

    Null html is an empty payload. A page without page_id has a record named by its uri and digest, which may revisit a page
    with an id and is a response otherwise. Rows that repeat a page_id and its payload are responses (or revisits) alike. An
    empty table writes no record. Other columns aren't read, whatever their names.
    """
    every = records(pages, date, least)
    largest = pages.agg(F.max(F.octet_length(F.col("html").cast("string")))).first()[0] or 0
    low = -1
    for k, high in enumerate([*bounds, None]):
        if low >= largest and low >= 0:
            break
        part = every.where(F.col("payload_bytes") > low)
        part = part if high is None else part.where(F.col("payload_bytes") <= high)
        many = 1 if high is None else max(1, file_bytes // high)
        part.select("value").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", many).text(f"{path}/size-{k}")
        low = high
    passing(pages.sparkSession, path)
    return path


def parse(stream):
    """(headers with lower-case names, block) of each record of a binary stream, of which one record at a time is held."""
    while first := stream.readline():
        if not re.match(rb"WARC/\d", first):
            raise ValueError("no WARC record")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().rstrip("\r\n").partition(": ")
            headers[k.lower()] = v
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size or stream.read(4) != b"\r\n\r\n":
            raise ValueError("record not ended")
        yield headers, block


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record, in full: a revisit's payload length is its response's. ``intact``: the block has the digest it names."""
    kinds = [("page_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("intact", pa.bool_())]
    schema = pa.schema(kinds)

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for h, block in parse(gzip.GzipFile(fileobj=pa.BufferReader(data.as_buffer()))):
                    digest, new = h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"] == "response"
                    to = h.get("warc-refers-to-page-id")
                    page = h.get("warc-page-id")
                    rows.append((int(page) if page else None, h["warc-target-uri"], h["warc-type"], digest, len(block) if new else None, int(to) if to else None, not new or b32encode(hashlib.sha1(block).digest()).decode() == digest))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length > 0").select("content")
    return files.mapInArrow(run, READ)


def resolve(read_back: DataFrame) -> DataFrame:
    """Fill in each revisit's payload_bytes from the response with its digest."""
    known = read_back.groupBy("payload_digest").agg(F.max(F.when(F.col("record_type") == "response", F.col("payload_bytes"))).alias("known"), F.count_if(F.col("record_type") == "revisit").alias("n"))
    out = joined_stats(read_back, staged(known.where("n > 0").drop("n"), "known"), "payload_digest", "left")
    return out.withColumn("payload_bytes", F.coalesce("payload_bytes", "known")).drop("known")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write archives to a fresh folder in the shared one, read them back once and resolve the revisits; odd rows as in write()."""
    spark = pages.sparkSession
    path = write(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}", least=least)
    return resolve(staged(read(spark, path), "parsed")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
