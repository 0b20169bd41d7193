from __future__ import annotations

import base64
import hashlib

import duckdb
import pytest

from quatrain.llm import warc
from quatrain.llm.common import scratch_path

ROWS = [
    (3, "http://a/x", "<p>one</p>", "clash"),
    (1, None, "<p>one</p>", "clash"),
    (2, "http://a/é\r\nx", "zwei ß 𠀀", "clash"),
    (2, "http://a/y", "zwei ß 𠀀", "clash"),
    (9, "http://a/z", None, "clash"),
    (8, "", "", "clash"),
    (None, "http://n", "only null", "clash"),
    (None, "http://n", "<p>one</p>", "clash"),
    (7, "http://long", "x" * 300_000, "clash"),
]
SCHEMA = "page_id long, url string, html string, address string"


def brute(rows, least):
    out = []
    for page, _, html, _ in rows:
        body = (html or "").encode()
        ids = [r[0] for r in rows if (r[2] or "").encode() == body and r[0] is not None]
        first = min(ids, default=None)
        revisit = page != first and len(body) >= least
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 11])
def test_index(spark, least):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    got = warc.archive_roundtrip(pages, least).drop("url").collect()
    assert sorted(map(tuple, got), key=str) == brute(ROWS, least)
    assert warc.archive_roundtrip(pages.limit(0)).count() == 0


def test_records_are_rebuilt(spark):
    path = scratch_path(spark, "test")
    warc.write_archive(spark.createDataFrame(ROWS, SCHEMA), path)
    records = warc.read_records(spark, path).collect()
    assert len(records) == len(ROWS)
    for r in records:
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert len(rest) == int(fields[b"Content-Length"]) + 4 and rest.endswith(b"\r\n\r\n")
        if fields[b"WARC-Type"] == b"response":
            assert rest[:-4].partition(b"\r\n\r\n")[2] == bytes(r["payload"])
        digest = base64.b32encode(hashlib.sha1(bytes(r["payload"])).digest())
        assert fields[b"WARC-Payload-Digest"] == b"sha1:" + digest
    assert spark.read.parquet(f"{path}/payloads").count() == len({r[2] or "" for r in ROWS})


def test_damage_is_noticed(spark):
    path = scratch_path(spark, "test")
    warc.write_archive(spark.createDataFrame(ROWS[:2], SCHEMA), path)
    spark.createDataFrame([("0" * 64, bytearray(b"other"))], "address string, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="match"):
        warc.verified_payloads(spark, path).select("payload_bytes").collect()


def test_sql(spark):
    rows = [r for r in ROWS if r[0] is not None and r[:1] != (2,)] + [ROWS[2]]
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", [r[:3] for r in rows])
    want = con.execute(warc.ROUNDTRIP_SQL).fetchall()
    got = warc.archive_roundtrip(spark.createDataFrame(rows, SCHEMA)).drop("url").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_text_ids_with_signs_of_the_header(spark):
    rows = [("b>%3E\r\n", None, "same"), ("a%>", "http://x", "same"), ("c", "http://x", "own")]
    got = warc.archive_roundtrip(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got) == [("a%>", "response", None), ("b>%3E\r\n", "revisit", "a%>"), ("c", "response", None)]
