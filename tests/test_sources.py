from __future__ import annotations

import io
import json
import random
import zipfile

import pytest

from quatrain import sources
from quatrain.sources import shards
from quatrain.sources.docx import body_paragraphs


def reader_of(data: bytes, took: list[int] | None = None):
    stream = io.BytesIO(data)

    def read(n):
        part = stream.read(n)
        if took is not None:
            took.append(len(part))
        return part

    return read


@pytest.mark.parametrize("chunk", [1, 2, 7, 1000])
def test_items_at_any_cut(chunk):
    rnd = random.Random(chunk)
    values = [{"a": "é𠀀\"\\ ]", "b": [1, {"c": None}]}, [], "x,]", 12.5e3, -7, True, None, {}, " ", *(rnd.randint(0, 10**9) for _ in range(20))]
    for given in (values, [], [[]], [12]):
        for indent in (None, 2):
            for ascii_only in (False, True):
                data = json.dumps(given, ensure_ascii=ascii_only, indent=indent).encode()
                assert list(shards.array_items(reader_of(b" \n" + data + b"\n "), chunk)) == given
    assert list(shards.array_items(reader_of(b"\xef\xbb\xbf[1]"), chunk)) == [1]
    assert list(shards.array_items(reader_of(b'{"no": "array"}'), chunk)) == [] == list(shards.array_items(reader_of(b""), chunk))
    for bad in (b"[1,]", b"[1 2]", b"[1", b"[", b'["a', b"[1] 2", b"[nope]", b"[{}"):
        with pytest.raises(ValueError):
            list(shards.array_items(reader_of(bad), chunk))


def test_items_come_before_the_shard_is_read():
    took: list[int] = []
    item = json.dumps({"paragraphs": ["x" * 90]}).encode()
    items = shards.array_items(reader_of(b"[" + b",".join([item] * 50_000) + b"]", took), 4096)
    next(items)
    assert sum(took) == 4096
    assert sum(1 for _ in items) == 49_999 and max(took) == 4096


def test_shards_beyond_the_limit_are_not_opened(spark, tmp_path):
    for n in (1000, 20, 3):
        (tmp_path / f"poet.tang.{n}.json").write_text(json.dumps([{"id": n, "author": " a ", "paragraphs": ["x", 3]}, {"paragraphs": []}, 5]), encoding="utf-8")
    (tmp_path / "poet.tang.4000.json").write_text("broken", encoding="utf-8")
    (tmp_path / "poet.tang.x.json").write_text("[broken", encoding="utf-8")
    rows = sources.read_json_shards(spark, str(tmp_path), max_files=2).orderBy("shard_no").collect()
    assert [tuple(r) for r in rows] == [("poet.tang.3.json", 3, 0, "3", "", "a", ["x"]), ("poet.tang.20.json", 20, 0, "20", "", "a", ["x"])]
    assert sources.read_json_shards(spark, f"file://{tmp_path}", max_files=4).count() == 3
    assert sources.read_json_shards(spark, str(tmp_path), max_files=0).count() == 0
    with pytest.raises(Exception, match="poet.tang.x.json"):
        sources.read_json_shards(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="no file matches"):
        sources.read_json_shards(spark, str(tmp_path), glob="none*.json").collect()
    assert sources.read_json_shards(spark, str(tmp_path), max_files=3).rdd.getNumPartitions() == 3


def test_a_store_that_only_spark_reads(spark, tmp_path):
    """viewfs is known to Spark alone."""
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.own.link./data", f"file://{tmp_path}")
    for n in (5, 40):
        (tmp_path / f"poet.tang.{n}.json").write_text(json.dumps([{"id": n, "paragraphs": ["x"]}]), encoding="utf-8")
    rows = sources.read_json_shards(spark, "viewfs://own/data", max_files=1).collect()
    assert [(r["source_file"], r["source_id"]) for r in rows] == [("poet.tang.5.json", "5")]


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def word_file(body: str) -> bytes:
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    return held.getvalue()


def p(text: str, more: str = "") -> str:
    return f"<w:p><w:pPr><w:tabs><w:tab/></w:tabs></w:pPr><w:r><w:t>{text}</w:t></w:r>{more}</w:p>"


def test_body_paragraphs_only(spark, tmp_path):
    box = f"<w:r><w:pict><w:txbxContent>{p('in a box')}{p('again')}</w:txbxContent></w:pict></w:r>"
    table = f"<w:tbl><w:tr><w:tc>{p('in a cell')}<w:tbl><w:tr><w:tc>{p('deeper')}</w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl>"
    link = "<w:hyperlink><w:r><w:t> a link</w:t></w:r></w:hyperlink><w:r><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t></w:r>"
    content = word_file(p("one", box) + table + p("  ") + f"<w:sdt><w:sdtContent>{p('in a control')}</w:sdtContent></w:sdt>" + p(" two", link) + "<w:sectPr/>")
    assert list(body_paragraphs(content)) == ["one", "  ", " two a link\tb\nc"]
    (tmp_path / "a.docx").write_bytes(content)
    (tmp_path / "b.docx").write_bytes(word_file(""))
    assert [(r["pos"], r["line"]) for r in sources.read_docx(spark, str(tmp_path)).orderBy("pos").collect()] == [(0, "one"), (1, "two a link\tb\nc")]
    spark.read.format("binaryFile").load(str(tmp_path)).createOrReplaceTempView("files")
    assert spark.sql("SELECT line FROM files, LATERAL word_paragraphs(content)").count() == 2
