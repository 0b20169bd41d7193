"""Registered queries that run something to its end and give what it left: counted writes, shards, labelling runs, streams."""

from __future__ import annotations

import json
from datetime import timedelta

from pyspark.sql import functions as F

from quatrain.functions import text as X
from quatrain.operators import annotate, forms
from quatrain.plans import CANDIDATES_SQL, FORM_SQL, ORACLE_SQL, RAW, VERSES, query, table
from quatrain.sources import read_json_shards, write_counted
from quatrain.sources.scratch import materialize, scratch_path
from quatrain.streaming.labelling import label_in_batches
from quatrain.streaming.sessions import STORE, stateful_sessions


@query(f"WITH {CANDIDATES_SQL} SELECT count(*) AS written, count(*) FILTER (form = 'quatrain') AS quatrain, count(*) FILTER (form = 'octave') AS octave FROM cand")
def counted_write(spark, sf_dir):
    """Candidates written as JSON lines, with the counts that the write itself gives."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source").withColumn("lines", X.raw_lines(F.col("text")))
    found = forms.keep_first(forms.with_form(docs, forms=VERSES), ["text"], ["doc_id"])
    counts = write_counted(found, scratch_path(spark, "candidates"), {f.name: F.col("form") == f.name for f in VERSES})
    return spark.createDataFrame([tuple(counts[k] for k in ("written", "quatrain", "octave"))], "written long, quatrain long, octave long")


#: Documents a shard, and the shards that are read.
SHARD_ROWS, SHARDS = 100, 7


@query(f"""
WITH d AS (
  SELECT doc_id, source, doc_id // {SHARD_ROWS} AS s, row_number() OVER (PARTITION BY doc_id // {SHARD_ROWS} ORDER BY doc_id) - 1 AS pos, {RAW} AS lines FROM documents
), first AS (
  SELECT DISTINCT s FROM d ORDER BY s LIMIT {SHARDS}
)
SELECT s AS shard_no, CAST(pos AS INTEGER) AS item_pos, 'd' || doc_id AS source_id, coalesce({FORM_SQL}, '') AS form, CAST(len(lines) AS BIGINT) AS n_lines
FROM d SEMI JOIN first USING (s) WHERE len(lines) > 0
""")
def shard_items(spark, sf_dir):
    """Documents written as shards of JSON arrays, and the items of the first shards read back as they are parsed."""
    docs = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / SHARD_ROWS).alias("s"), "doc_id", F.coalesce("source", F.lit("")).alias("author"), X.raw_lines(F.col("text")).alias("paragraphs"))
    item = F.struct(F.concat(F.lit("d"), "doc_id").alias("id"), "author", "paragraphs")
    # a shard has so many documents at most
    arrays = docs.groupBy("s").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", item.alias("item")))), lambda x: x["item"])).alias("value"))
    path = scratch_path(spark, "shards")
    arrays.select("value", F.concat(F.lit("poet.tang."), "s").alias("shard")).write.partitionBy("shard").text(path)
    folder = scratch_path(spark, "named")
    _named(spark, path, folder)
    items = read_json_shards(spark, folder, max_files=SHARDS)
    named = items.withColumn("form", F.coalesce(forms.detect_form(F.col("paragraphs"), VERSES), F.lit("")))
    return named.select("shard_no", "item_pos", "source_id", "form", F.size("paragraphs").cast("long").alias("n_lines"))


def _named(spark, path: str, folder: str) -> None:
    """Spark names files itself; shards have names of their own."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    store = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)
    store.mkdirs(jvm.org.apache.hadoop.fs.Path(folder))
    for found in store.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/shard=*/part-*")):
        place = found.getPath()
        store.rename(place, jvm.org.apache.hadoop.fs.Path(f"{folder}/{place.getParent().getName().removeprefix('shard=')}.json"))


TAXONOMY = {"emotion": ["joy", "grief"], "diction": ["plain"], "expression": ["direct"], "energy": ["still"]}


def _answer(**changes) -> str:
    one = lambda v: {"value": v, "confidence": 0.5, "evidence": []}
    return json.dumps({"emotion": one(["joy"]), "diction": one("plain"), "expression": one("direct"), "energy": one("still")} | changes)


def _first_client(prompt: str) -> str:
    if int(prompt) % 3 == 0:
        raise RuntimeError("time ran out")
    return _answer()


def _second_client(prompt: str) -> str:
    return _answer(energy={"value": "loud", "confidence": 0.5, "evidence": []}) if int(prompt) % 2 == 0 else _answer()


@query("""
SELECT conv_id, turn, n % 3 <> 0 OR n % 2 = 1 AS complete, CASE WHEN n % 3 <> 0 THEN 0 WHEN n % 2 = 1 THEN 1 ELSE 2 END::BIGINT AS n_errors,
       CASE WHEN n % 3 = 0 AND n % 2 = 0 THEN 'energy: label not allowed' END AS last_error
FROM (SELECT conv_id, turn, length(coalesce(text, '')) AS n FROM conversations)
""")
def labelled_in_batches(spark, sf_dir):
    """Two labelling runs over all turns: what the first leaves pending the second asks again, and errors of both stay."""
    pending = F.struct(*[annotate.pending(d).alias(d) for d in annotate.MODEL_DIMS])
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    first, _ = materialize(talks.select("*", F.struct(pending.alias("prelabel"), F.lit(None).cast(annotate.ERRORS).alias("errors")).alias("annotation")), "pending")
    place, prompt = first.inputFiles()[0].rsplit("/", 1)[0], F.length("text").cast("string")
    for client in (_first_client, _second_client):
        out = scratch_path(spark, "labelled")
        label_in_batches(spark, place, out, scratch_path(spark, "checkpoint"), client, TAXONOMY, files_per_batch=4, prompt=prompt)
        place = out
    rows = spark.read.parquet(place)
    last = F.when(F.size("annotation.errors") > 1, F.element_at("annotation.errors", -1)["message"])
    return rows.select("conv_id", "turn", annotate.is_complete(F.col("annotation.prelabel")).alias("complete"), F.size("annotation.errors").cast("long").alias("n_errors"), last.alias("last_error"))


#: Micro-batches that the table's time is cut into.
SLICES = 4


@query(ORACLE_SQL["event_sessions"])
def stateful_event_sessions(spark, sf_dir):
    """All events as a stream of files in order of time; sessions close by timers as the watermark passes them."""
    events = table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(at), F.max(at)).first()
    path, out, checkpoint = (scratch_path(spark, n) for n in ("events", "sessions", "checkpoint"))
    kind = events.schema["ts"].dataType
    cut = F.lit(SLICES - 1) if low is None else F.floor((at - low) * SLICES / (high - low + 1))
    for k in range(SLICES):
        events.where(cut == k).coalesce(1).write.mode("append").parquet(path)
    # two ticks behind the end: the first moves the clock on, the second lets it ring
    for tick in (1, 2) if low is not None else ():
        ahead = F.timestamp_micros(F.lit(high) + tick * 86_400_000_000).cast(kind)
        spark.range(1).select(*[(ahead if f.name == "ts" else F.lit(None).cast(f.dataType)).alias(f.name) for f in events.schema]).write.mode("append").parquet(path)
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    stream = own.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    closed = stateful_sessions(stream, gap=timedelta(minutes=30))
    closed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(closed.schema).parquet(out)
