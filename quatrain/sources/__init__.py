"""Readers and writers: JSON shards, JSON lines, documents, fingerprints, remote shards."""

from __future__ import annotations

import json
import os
import tempfile
import time
import urllib.request
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quatrain.functions import text as X
from quatrain.sources.docx import WORD_XML, WordParagraphs, read_docx
from quatrain.sources.shards import NUMBER, JsonShards, store_of
from quatrain.sources.shards import SCHEMA as SHARD_SCHEMA


def read_json_shards(spark: SparkSession, path: str, glob: str = "poet.tang.*.json", max_files: int | None = None) -> DataFrame:
    """(source_file, shard_no, item_pos, source_id, title, author, paragraphs) of JSON-array files in a folder, of the first
    max_files by number. One partition a shard, parsed as it is read, so a shard of any size takes the memory of its largest
    item. Files that hold no array, items that are no objects and items without a non-empty list of paragraphs are left
    out one by one; what is no JSON raises ValueError with the file's name. If no file matches, FileNotFoundError is raised.

    In a store that only Spark can read, the files are listed by Spark, and those wanted are read whole."""
    try:
        store_of(path)
    except (OSError, pa.ArrowException):
        listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path")
        numbered = listed.withColumn("n", X.shard_number(F.col("path"), NUMBER.pattern.replace("\\Z", "\\z"))).orderBy("n", "path")
        wanted = [r["path"] for r in (numbered if max_files is None else numbered.limit(max_files)).collect()]
        if not wanted and listed.isEmpty():
            raise FileNotFoundError(f"{path}: no file matches {glob}") from None
        if not wanted:
            return spark.createDataFrame([], SHARD_SCHEMA)
        files = spark.read.option("wholetext", True).text(wanted)
        return parse_shards(files.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file"), "value"))
    spark.dataSource.register(JsonShards)
    reader = spark.read.format("json_shards").option("path", path).option("glob", glob)
    return (reader if max_files is None else reader.option("max_files", str(max_files))).load()


def parse_shards(files: DataFrame, max_files: int | None = None) -> DataFrame:
    """The same of (source_file, value), files' names and whole contents."""
    named = files.select("source_file", "value").withColumn("shard_no", X.shard_number(F.col("source_file")))
    if max_files is not None:
        first = named.select("shard_no", "source_file").distinct().orderBy("shard_no", "source_file").limit(max_files)
        named = named.join(first, ["shard_no", "source_file"], "left_semi")
    parsed = named.withColumn("v", F.try_parse_json("value"))
    array = parsed.where(F.schema_of_variant("v").startswith("ARRAY"))
    items = array.select("source_file", "shard_no", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("item_pos", "item"))
    objects = items.where(F.schema_of_variant("item").startswith("OBJECT"))
    get = lambda k, kind: F.try_variant_get("item", f"$.{k}", kind)
    listed = objects.withColumn("p", get("paragraphs", "array<variant>")).where(F.size("p") > 0)
    strings = F.transform(F.filter("p", lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
    return listed.select(
        "source_file", "shard_no", "item_pos",
        X.or_blank(get("id", "string"), stripped=False).alias("source_id"), X.or_blank(get("title", "string")).alias("title"), X.or_blank(get("author", "string")).alias("author"),
        strings.alias("paragraphs"),
    )


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines, strictly: a line that is no JSON object raises ValueError with its file, number and text."""
    typed = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*\z"))
    objects = lines.withColumn("k", F.schema_of_variant(F.try_parse_json("value")))
    wrong = objects.where(~F.coalesce(F.col("k").startswith("OBJECT"), F.lit(False))).select(F.input_file_name().alias("f"), "value").limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0]['f']}:{_line_number(spark, wrong[0]['f'], wrong[0]['value'])}: not a JSON object: {wrong[0]['value'][:200]}")
    return spark.read.schema(typed).json(path)


def _line_number(spark: SparkSession, file: str, line: str) -> int:
    """1-based number of the first such line, counted in one pass over the one file."""
    ahead = spark.read.option("wholetext", True).text(file).select(F.substring_index(F.concat(F.lit("\n"), "value"), "\n" + line, 1).alias("a"))
    return ahead.select((F.size(F.split("a", "\n"))).alias("n")).first()["n"]


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines that keep null fields."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_counted(df: DataFrame, path: str, counts: Mapping[str, Column], write: Callable[[DataFrame, str], None] = write_jsonl) -> dict[str, int]:
    """Write df, and what the write itself has counted: written, and each of counts (conditions). One job, no second pass
    over the rows, and a task that is tried again is counted once."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("written"), *[F.count_if(c).alias(k) for k, c in counts.items()]), path)
    return dict(seen.get)


def read_config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    if not isinstance(found, dict):
        raise ValueError(f"{path}: not an object")
    return found


def taxonomy_of(config: dict, dimensions: tuple[str, ...], section: str = "style") -> dict[str, list[str]]:
    """Allowed values of each dimension of {section: {name: {values: ...}}}; values may be a list or an object of names.
    A dimension that is not there, or that allows nothing, raises ValueError."""
    out = {}
    for d in dimensions:
        block = (config.get(section) or {}).get(d)
        values = list(block.get("values") or ()) if isinstance(block, dict) else []
        if not values:
            raise ValueError(f"the schema has no values for dimension {d}")
        out[d] = [str(v) for v in values]
    return out


def asked_names(raw: str, allowed: tuple[str, ...]) -> list[str]:
    """Names of a comma-separated list, once each in order; none, or one that is not allowed, raises ValueError."""
    names = list(dict.fromkeys(x.strip() for x in raw.split(",") if x.strip()))
    unknown = [n for n in names if n not in allowed]
    if unknown:
        raise ValueError(f"unknown: {', '.join(unknown)}; allowed: {', '.join(allowed)}")
    if not names:
        raise ValueError("at least one name is needed")
    return names


def lexicon_table(spark: SparkSession, config: dict) -> DataFrame:
    """(category, cat_pos, term) of {categories: {name: [term]}}."""
    categories = config.get("categories")
    if not isinstance(categories, dict):
        raise ValueError("categories must be an object")
    rows = [(c, i, t) for i, (c, terms) in enumerate(categories.items()) for t in terms]
    return spark.createDataFrame(rows, "category string, cat_pos int, term string")


def taxonomy_table(spark: SparkSession, config: dict, section: str = "style") -> DataFrame:
    """(dim, type, min_items, max_items, value, zh) of {section: {dim: {type, min_items, max_items, values}}}."""
    rows = []
    for dim, spec in config[section].items():
        values = spec.get("values", {})
        pairs = values.items() if isinstance(values, dict) else ((v, v) for v in values)
        rows += [(dim, spec.get("type"), spec.get("min_items"), spec.get("max_items"), k, str(z)) for k, z in pairs]
    return spark.createDataFrame(rows, "dim string, type string, min_items int, max_items int, value string, zh string")


def write_report(df: DataFrame, path: str) -> None:
    """A report of one row as indented JSON."""
    row = df.first()
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(row.asDict(recursive=True), ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def http_get(url: str, tries: int = 3, timeout: int = 30, opener: Callable = urllib.request.urlopen, wait: Callable = time.sleep) -> bytes:
    """GET with linear back-off; RuntimeError after the last try."""
    for n in range(1, tries + 1):
        try:
            with opener(url, timeout=timeout) as answer:
                return answer.read()
        except OSError as e:
            last = e
            if n < tries:
                wait(n)
    raise RuntimeError(f"{url}: {last}")


def list_shards(listing: list[dict], pattern: str = r"poet\.tang\.(\d+)\.json") -> list[dict]:
    """Entries of a directory listing that are shards with an address, by number; none is an error."""
    import re

    found = [(int(m[1]), x["name"], x) for x in listing if x.get("download_url") and (m := re.fullmatch(pattern, x.get("name", "")))]
    if not found:
        raise RuntimeError("no shards in the listing")
    return [x for _, _, x in sorted(found, key=lambda r: r[:2])]


def fetch_missing(shards: list[dict], folder: str, get: Callable[[str], bytes], threads: int = 6, max_files: int | None = None) -> list[str]:
    """Fetch shards that are missing or empty; a file appears only after its content proved to be a JSON list."""
    os.makedirs(folder, exist_ok=True)
    wanted = shards[:max_files]

    def fetch(shard: dict) -> str:
        target = Path(folder, shard["name"])
        if not target.exists() or not target.stat().st_size:
            content = get(shard["download_url"])
            if not isinstance(json.loads(content), list):
                raise RuntimeError(f"{shard['name']}: not a JSON list")
            with tempfile.NamedTemporaryFile(dir=folder, suffix=".tmp", delete=False) as f:
                f.write(content)
            os.replace(f.name, target)
        return str(target)

    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(fetch, wanted))


def chat_client(url: str, key: str, model: str, temperature: float, max_tokens: int, timeout: int, opener: Callable = urllib.request.urlopen) -> Callable[[str], str]:
    """A client for annotate.ask_model. Batch labelling uses temperature 0 and 700 tokens, the service 0.8 and 1200."""

    def ask(prompt: str) -> str:
        body = {"model": model, "messages": [{"role": "user", "content": prompt}], "temperature": temperature, "max_tokens": max_tokens}
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Authorization": f"Bearer {key}", "Content-Type": "application/json"})
        try:
            with opener(request, timeout=timeout) as answer:
                return json.loads(answer.read())["choices"][0]["message"]["content"]
        except (OSError, KeyError, IndexError, ValueError) as e:
            raise RuntimeError(f"model call failed: {e}") from e

    return ask
