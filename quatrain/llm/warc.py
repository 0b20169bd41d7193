"""Content-addressed web archives.

An archive is two tables on shared storage. Payloads hold each distinct payload once, under its SHA-256. Headers hold
for every page the exact bytes that come before the payload in its WARC record (record header, and the HTTP header of a
response), with the digest that they point to. Records are rebuilt by joining the two. A response is its header, the
payload and two line ends; a revisit is its header and two line ends, and its page's content is the payload it points to.

Of records with equal payloads of at least min_bytes bytes the one with the smallest page id is the response; the others
revisit it. Smaller ones are all responses.

Writing: least ids and payloads are aggregated by digest, with partial aggregation, so a payload that a third of all
pages share sends one row a task. Reading verifies every stored payload against its address and joins headers to payloads
to the records' exact bytes, from which lengths, digests and links are then read; a hot digest's headers are left to
Spark's splitting of skewed joins, and its payload is sent once a split.

Defined results: null pages have empty payloads; a null or unparsable URL leaves the target header out (line breaks in
URLs are percent-encoded); rows that repeat an id with an equal payload are all responses, stored once; of records with
a null id one is the response only if all of its group have null ids (then all are); an empty table gives empty archives
and results; very long pages are treated like any other; signs in text ids that would end a header field are
percent-encoded; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quatrain.llm.common import scratch_path

LINE = "\r\n"
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 160 bits are four times 40 bits, which are 10 hexadecimal or 8 base-32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


#: Signs that an id must not bring into a header line, and what stands for them; the sign of the escape comes first.
ESCAPES = (("%", "%25"), (">", "%3E"), ("\r", "%0D"), ("\n", "%0A"))


def _id_uri(column: Column) -> Column:
    name = column.cast("string")
    for sign, code in ESCAPES:
        name = F.replace(name, F.lit(sign), F.lit(code))
    return F.concat(F.lit("<urn:page:"), F.coalesce(name, F.lit("none")), F.lit(">"))


def _id_of(uri: Column, kind: str) -> Column:
    for sign, code in reversed(ESCAPES):
        uri = F.replace(uri, F.lit(code), F.lit(sign))
    return uri.cast(kind)


def _header(date: str) -> Column:
    """Everything of a record that stands before its payload."""
    response = F.col("record_type") == "response"
    http = F.concat_ws(
        LINE, F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.col("payload_bytes").cast("string")), F.lit(""), F.lit("")
    )
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _id_uri(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), F.lit(date)),
        F.when(F.length(url) > 0, F.concat(F.lit("WARC-Target-URI: "), url)),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(~response, F.concat(F.lit("WARC-Refers-To: "), _id_uri(F.col("first_id")))),
        F.when(~response, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(response, F.lit("Content-Type: application/http; msgtype=response")),
        F.concat(F.lit("Content-Length: "), F.when(response, F.octet_length(http) + F.col("payload_bytes")).otherwise(0).cast("string")),
        F.lit(""),
        F.lit(""),
    ]
    return F.concat(F.concat_ws(LINE, *lines), F.when(response, http).otherwise(""))


def write_archive(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z"
) -> None:
    """Write path/headers and path/payloads (Parquet)."""
    bodies = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    )
    sized = bodies.withColumn("address", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    thin = sized.select("page_id", "url", "address", "payload_bytes", base32_sha1(F.col("payload")).alias("payload_digest"))
    firsts = thin.groupBy("address").agg(F.min("page_id").alias("first_id"))
    revisit = (F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    headers = thin.join(firsts, "address").withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
    headers.select("page_id", _header(date).alias("header"), "address").write.option("compression", "zstd").parquet(f"{path}/headers")
    # equal payloads of a task fall together before the exchange
    sized.groupBy("address").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")


def verified_payloads(spark: SparkSession, path: str) -> DataFrame:
    """address, payload, payload_bytes and payload_digest of the store; a payload that is not what its address says
    raises an error."""
    stored = spark.read.parquet(f"{path}/payloads")
    sound = F.when(F.sha2("payload", 256) == F.col("address"), F.octet_length("payload").cast("long")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not match its address "), F.col("address"))).cast("long")
    )
    return stored.select("address", "payload", sound.alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record (the WARC record's exact bytes), payload (of the page, also for revisits)."""
    headers = spark.read.parquet(f"{path}/headers")
    joined = headers.join(verified_payloads(spark, path), "address")
    response = _field("WARC-Type") == "response"
    block = F.when(response, F.col("payload")).otherwise(F.lit(b""))
    return joined.select("page_id", F.concat(F.encode("header", "UTF-8"), block, F.lit(b"\r\n\r\n")).alias("record"), "payload")


def _field(name: str, head: str = "header") -> Column:
    return F.regexp_extract(head, rf"\r\n{name}: ([^\r]*)(?:\r\n|\z)", 1)


def read_pages(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """Per page, from the bytes of its rebuilt record: page_id, url, payload_bytes, payload_digest, record_type and
    refers_to. A response's payload is cut out of the record by the lengths it states; a revisit's is the payload its
    digest points to. A payload that is not what its header says raises an error."""
    blank = LINE + LINE
    parts = read_records(spark, path).select("page_id", "record", "payload", F.substring_index(F.col("record").cast("string"), blank, 1).alias("head"))
    block = F.substring(F.col("record"), F.octet_length("head") + 5, _field("Content-Length", "head").cast("int"))
    blocked = parts.select("page_id", "head", "payload", _field("WARC-Type", "head").alias("record_type"), block.alias("block"))
    http = F.octet_length(F.substring_index(F.col("block").cast("string"), blank, 1))
    own = F.when(F.col("record_type") == "response", F.substring(F.col("block"), http + 5, F.octet_length("block"))).otherwise(F.col("payload"))
    found = blocked.select("page_id", "head", "record_type", own.alias("payload")).withColumn("digest", base32_sha1(F.col("payload")))
    said = _field("WARC-Payload-Digest", "head")
    url = _field("WARC-Target-URI", "head")
    refers = F.regexp_extract("head", "\r\nWARC-Refers-To: <urn:page:([^>]*)>", 1)
    return found.select(
        "page_id",
        F.when(url != "", url).alias("url"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(said == F.concat(F.lit("sha1:"), F.col("digest")), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("no payload as the header says: "), said)).cast("string")).alias("payload_digest"),
        "record_type",
        F.when(F.col("record_type") == "revisit", _id_of(refers, id_type)).alias("refers_to"),
    )


def archive_roundtrip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages to an archive in the shared folder, rebuild the records and read them."""
    spark = pages.sparkSession
    path = scratch_path(spark, "archive")
    write_archive(pages, path, min_bytes=min_bytes)
    return read_pages(spark, path, pages.schema["page_id"].dataType.simpleString())


#: Digest arithmetic as in base32_sha1: per group of 10 hexadecimal digits eight base-32 digits.
ROUNDTRIP_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS hex FROM pages
), g AS (
  SELECT page_id, octet_length(body) AS payload_bytes, hex,
         min(page_id) OVER (PARTITION BY body) AS first_id FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(hex, CAST(10 * (k // 8) + 1 AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (k % 8) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM g
"""
