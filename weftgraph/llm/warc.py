"""A content-addressed web archive.

Two tables in one folder. `payloads` has every distinct payload once, under its SHA-256; `headers` has a record for
each page: its URL, the exact bytes of its WARC header and of its HTTP header, and the SHA-256 of its payload. Reading
joins the two. A payload is checked once, as it is stored, and its digest and length are compared with those that each
header names. The original of a revisit record comes back by the same join, as both name one payload.

A payload is stored from one aggregation by digest, which leaves each task with one row a digest at most, so a
payload that a third of all pages share is no hot group. Headers are narrow rows; rows alike in page, URL and payload
are one counted row until they are written. What the join has to carry is what is asked for: without the payload
column, no payload is shuffled.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payloads of at least so many bytes are stored once; further records of them are revisits.
LEAST_BYTES = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An extension field: the page's id as it was given.
PAGE, REFERS = "WARC-Weft-Page", "WARC-Weft-Refers-To-Page"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 (RFC 4648) SHA-1 of bytes: each five hex digits are four letters."""
    digest = F.sha1(payload)
    part = lambda i: F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0")
    return F.translate(F.upper(F.concat(*[part(i) for i in range(8)])), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page_id: Column, url: Column, sha256: Column, copy: Column) -> Column:
    """A UUID of a record's page, URL, payload and the number of its copy: the same on every run."""
    text = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    h = F.md5(F.concat_ws("\n", text(page_id), text(url), F.hex(sha256), copy.cast("string")).cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("3"), part(14, 3)), F.concat(F.lit("8"), part(18, 3)), part(21, 12)), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header field; none for a null value."""
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _uri(url: Column) -> Column:
    """Line ends, which no field can hold, are percent-encoded; the URL itself is kept beside the header."""
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def http_header(payload_bytes: Column) -> Column:
    """The header of the HTTP response that a record stands for."""
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), payload_bytes.cast("string"), F.lit("\r\n\r\n")).cast("binary")


def header_value(header: Column, name: str) -> Column:
    """A field of header bytes, null where it is absent."""
    found = F.regexp_extract(header.cast("string"), rf"(?:\A|\r\n){name}: ([^\r\n]*)", 1)
    return F.when(header.cast("string").rlike(rf"(?:\A|\r\n){name}: "), found)


def write_archive(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, date: str | None = None) -> None:
    """Archive pages (page_id long, url, html; others are left aside) in a folder that isn't there yet.

    A null html is an empty payload. Of records with equal payloads of at least least_bytes, the one with the smallest
    page_id is the response (of several, that of the first URL; of rows that are alike, any one) and all others revisit
    it; smaller payloads are all responses. Rows without a page_id, or a URL, come after those with one. date is the
    WARC-Date of all records, by default the time of the call.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    html = F.coalesce("html", F.lit("")).cast("binary")
    place = F.struct(F.col("page_id").isNull().alias("no_page"), "page_id", F.col("url").isNull().alias("no_url"), "url")
    body = pages.select("page_id", "url", html.alias("payload")).withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    stored = body.groupBy("sha256").agg(F.min(place).alias("first"), F.first("payload").alias("payload"))
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")
    kept = pages.sparkSession.read.parquet(f"{path}/payloads")
    # digests of the payload once for each that is stored, not for each page
    firsts = kept.select("sha256", "first", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("digest"))
    narrow = body.select("page_id", "url", "sha256").groupBy("page_id", "url", "sha256").agg(F.count("*").alias("copies"))
    told = narrow.join(firsts, "sha256").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    first = F.col("first")
    is_first = (F.col("copy") == 1) & F.col("page_id").eqNullSafe(first["page_id"]) & F.col("url").eqNullSafe(first["url"])
    told = told.withColumn("response", (F.col("payload_bytes") < least_bytes) | is_first).withColumn("http", http_header(F.col("payload_bytes")))
    block = F.octet_length("http") + F.when(F.col("response"), F.col("payload_bytes")).otherwise(0)
    header = F.concat_ws(
        "",
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(F.col("response"), "response").otherwise("revisit")),
        _line("WARC-Record-ID", record_id(F.col("page_id"), F.col("url"), F.col("sha256"), F.col("copy"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", _uri(F.col("url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(~F.col("response"), F.concat_ws("", _line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", record_id(first["page_id"], first["url"], F.col("sha256"), F.lit(1))), _line("WARC-Refers-To-Target-URI", _uri(first["url"])), _line(REFERS, first["page_id"].cast("string")))),
        _line(PAGE, F.col("page_id").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", block.cast("string")),
        F.lit("\r\n"),
    ).cast("binary")
    told.select(header.alias("header"), "http", "url", "sha256").write.option("compression", "zstd").parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(header, http, url, payload, payload_bytes, payload_digest, sound): every record with its original payload.

    payload_bytes and payload_digest are those of the stored bytes. sound: the payload's SHA-256 is the key it is
    stored under, its SHA-1 is that of the WARC header, and its length that of the HTTP header and of the block.
    """
    headers, stored = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    intact = F.unhex(F.sha2("payload", 256)) == F.col("sha256")
    checked = stored.select("sha256", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"), intact.alias("intact"))
    both = headers.join(checked, "sha256", "left")
    value = lambda name: header_value(F.col("header"), name)
    block = F.octet_length("http") + F.when(value("WARC-Type") == "response", F.col("payload_bytes")).otherwise(0)
    good = F.col("intact") & (F.concat(F.lit("sha1:"), "payload_digest") == value("WARC-Payload-Digest")) & (block.cast("string") == value("Content-Length")) & (F.col("http") == http_header(F.col("payload_bytes")))
    return both.select("header", "http", "url", "payload", "payload_bytes", "payload_digest", F.coalesce(good, F.lit(False)).alias("sound"))


def record_bytes(header: Column, http: Column, payload: Column) -> Column:
    """A record as it stands in a WARC file: the block of a revisit ends with the HTTP header."""
    body = F.when(header_value(header, "WARC-Type") == "response", payload).otherwise(F.lit(b""))
    return F.concat(header, http, body, F.lit(b"\r\n\r\n"))


def described(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, sound), from headers and payloads read back."""
    value = lambda name: header_value(F.col("header"), name)
    return records.select(value(PAGE).cast("long").alias("page_id"), "payload_bytes", "payload_digest", value("WARC-Type").alias("record_type"), value(REFERS).cast("long").alias("refers_to"), "sound")
