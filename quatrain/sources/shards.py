"""Shards of JSON arrays as a data source: one partition a shard, items as they are parsed."""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Callable, Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "source_file string, shard_no bigint, item_pos int, source_id string, title string, author string, paragraphs array<string>"
NUMBER = re.compile(r"\.(\d+)\.json\Z")
LAST = 9223372036854775807
CHUNK, ROWS = 1 << 20, 2000
#: Nothing, and signs that may come next in a number.
_GOES_ON = ("", *".eE+-0123456789")
_BLANK = re.compile(r"[ \t\n\r]*")


def array_items(read: Callable[[int], bytes], chunk: int = CHUNK) -> Iterator[object]:
    """Items of a JSON array as they are read; nothing if the value is no array. What is held is the item at hand and a
    chunk; a longer item is tried again only when as much again has been read, so time stays linear. Raises ValueError
    for what is no JSON."""
    decode, parse = codecs.getincrementaldecoder("utf-8-sig")().decode, json.JSONDecoder().raw_decode
    held, at, over = "", 0, False

    def more(n: int) -> None:
        nonlocal held, at, over
        new = read(n)
        over = not new
        held, at = held[at:] + decode(new, over), 0

    def sign() -> str:
        """The next sign that is no blank, or nothing at the end."""
        nonlocal at
        while True:
            at = _BLANK.match(held, at).end()
            if at < len(held) or over:
                return held[at : at + 1]
            more(chunk)

    if sign() != "[":
        return
    at += 1
    closed = sign() == "]"
    while not closed:
        sign()
        while True:
            try:
                item, end = parse(held, at)
                # a number may go on in what has not been read yet
                if over or held[end : end + 1] not in _GOES_ON:
                    break
            except ValueError:
                if over:
                    raise
            more(max(chunk, len(held) - at))
        at = end
        yield item
        mark = sign()
        if mark not in (",", "]"):
            raise ValueError(f"neither comma nor end of the array: {held[at : at + 40]!r}")
        closed = mark == "]"
        at += not closed
    at += 1
    if sign():
        raise ValueError(f"more than one value: {held[at : at + 40]!r}")


def shard_rows(name: str, items: Iterator[object]) -> Iterator[tuple]:
    """Rows of SCHEMA for items that are objects with a non-empty list of paragraphs."""
    found = NUMBER.search(name)
    number = int(found[1]) if found else LAST
    for pos, item in enumerate(items):
        if not isinstance(item, dict):
            continue
        paragraphs = item.get("paragraphs")
        if isinstance(paragraphs, list) and paragraphs:
            text = lambda k: str(item.get(k) or "")  # noqa: E731, B023
            yield name, number, pos, text("id"), text("title").strip(), text("author").strip(), [p for p in paragraphs if isinstance(p, str)]


def store_of(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


class Shard(InputPartition):
    def __init__(self, root: str, place: str):
        self.root, self.place = root, place


class ShardReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.glob = options["path"], options.get("glob", "*.json")
        most = options.get("max_files")
        self.most = None if most is None else int(most)

    def partitions(self) -> list[Shard]:
        """The first max_files shards by number and name; no other is opened."""
        store, where = store_of(self.path)
        files = store.get_file_info(pa.fs.FileSelector(where))
        places = [f.path for f in files if f.type == pa.fs.FileType.File and fnmatchcase(f.base_name, self.glob)]
        if not places:
            raise FileNotFoundError(f"{self.path}: no file matches {self.glob}")
        name = lambda p: p.rsplit("/", 1)[-1]
        number = lambda p: int(m[1]) if (m := NUMBER.search(name(p))) else LAST
        return [Shard(self.path, p) for p in sorted(places, key=lambda p: (number(p), name(p)))[: self.most]]

    def read(self, partition: Shard | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # how Spark reads a source without partitions
            return
        name = partition.place.rsplit("/", 1)[-1]
        with store_of(partition.root)[0].open_input_stream(partition.place) as stream:
            rows: list[tuple] = []
            try:
                for row in shard_rows(name, array_items(stream.read)):
                    rows.append(row)
                    if len(rows) == ROWS:
                        yield _batch(rows)
                        rows = []
            except ValueError as e:
                raise ValueError(f"{partition.place}: {e}") from e
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in SCHEMA.split(", ")])


class JsonShards(DataSource):
    """spark.read.format("json_shards"): path of a folder, glob of its shards, max_files."""

    @classmethod
    def name(cls) -> str:
        return "json_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ShardReader:
        return ShardReader(self.options)
