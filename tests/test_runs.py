from __future__ import annotations

import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from quatrain.operators import annotate
from quatrain.sources import write_counted
from quatrain.streaming import labelling
from quatrain.streaming.sessions import STORE, stateful_sessions

TAXONOMY = {"emotion": ["joy", "grief"], "diction": ["plain"], "expression": ["direct"], "energy": ["still"]}


def answer(energy="still"):
    one = lambda v: {"value": v, "confidence": 0.5, "evidence": []}
    return json.dumps({"emotion": one(["joy"]), "diction": one("plain"), "expression": one("direct"), "energy": one(energy)})


def records(spark, folder):
    pending = F.struct(*[annotate.pending(d).alias(d) for d in annotate.MODEL_DIMS])
    rows = spark.range(12).select("id", F.concat(F.lit("poem "), "id").alias("text"), F.struct(pending.alias("prelabel"), F.lit(None).cast(annotate.ERRORS).alias("errors")).alias("annotation"))
    for k in range(3):
        rows.where(F.col("id") % 3 == k).coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


def test_a_run_that_breaks_off_goes_on(spark, tmp_path, monkeypatch):
    source, log = records(spark, tmp_path / "in"), tmp_path / "asked"
    log.write_text("")
    place, good, loud = str(log), answer(), answer("loud")

    def client(prompt):
        with open(place, "a") as f:
            f.write(prompt + "\n")
        if int(prompt) % 4 == 0:
            raise RuntimeError("time ran out")
        return good

    out, notes = str(tmp_path / "out"), str(tmp_path / "notes")
    run = lambda: labelling.label_in_batches(spark, source, out, notes, client, TAXONOMY, prompt=F.col("id").cast("string"))
    real, calls = annotate.ask_model, []

    def breaks(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("killed ahead of the second batch")
        return real(*args)

    monkeypatch.setattr(annotate, "ask_model", breaks)
    with pytest.raises(Exception, match="killed"):
        run()
    assert len(log.read_text().split()) == 4
    monkeypatch.setattr(annotate, "ask_model", real)
    counts = run()
    assert counts["attempted"] == 8 and counts["succeeded"] + counts["failed"] == 8
    # no record was asked twice, and all are there once
    assert sorted(map(int, log.read_text().split())) == list(range(12))
    rows = spark.read.parquet(out)
    assert sorted(r["id"] for r in rows.collect()) == list(range(12))
    assert run() == {"attempted": 0, "succeeded": 0, "failed": 0}
    # a further run asks what is pending, and keeps the errors of the first
    again = labelling.label_in_batches(spark, out, str(tmp_path / "out2"), str(tmp_path / "notes2"), lambda p: loud if p == "4" else good, TAXONOMY, files_per_batch=9, prompt=F.col("id").cast("string"))
    assert again == {"attempted": 3, "succeeded": 2, "failed": 1}
    last = {r["id"]: r["annotation"] for r in spark.read.parquet(str(tmp_path / "out2")).collect()}
    assert [e["message"] for e in last[4]["errors"]] == ["time ran out", "energy: label not allowed"] and [e["message"] for e in last[8]["errors"]] == ["time ran out"]
    assert last[8]["prelabel"]["energy"]["status"] == "prelabeled" and last[4]["prelabel"]["energy"]["status"] == "pending_llm" and not last[1]["errors"]


def test_an_answer_is_checked_once_a_row(spark):
    rows = spark.range(3).select("id", F.lit("text").alias("text"), F.lit(answer()).alias("answer"), F.struct(F.struct(*[annotate.pending(d).alias(d) for d in annotate.MODEL_DIMS]).alias("prelabel"), F.lit(None).cast(annotate.ERRORS).alias("errors")).alias("annotation"))
    asked = annotate.ask_model(rows, "answer", lambda p: p, "__answer")
    labelled = annotate.apply_answers(asked, "__answer", TAXONOMY, labelling.LABEL, failure_col="failure").select(*rows.columns)
    wide = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        plan = labelled._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", wide)
    # the check names the answer and its parts some hundred times
    assert plan.count("not allowed") == len(annotate.MODEL_DIMS) and plan.lower().count("json") < 50
    assert all(r["annotation"]["prelabel"]["energy"]["value"] == "still" for r in labelled.collect())


def test_counts_of_the_write_itself(spark, tmp_path):
    df = spark.range(100).withColumn("form", F.when(F.col("id") % 4 == 0, "a").when(F.col("id") % 4 == 1, "b")).repartition(5)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "counted")
    counts = write_counted(df, str(tmp_path / "out"), {"a": F.col("form") == "a", "none": F.col("form").isNull()})
    jobs = tracker.getJobIdsForGroup("counted")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts == {"written": 100, "a": 25, "none": 50} and spark.read.json(str(tmp_path / "out")).count() == 100
    # adaptive execution runs the shuffle as a job of its own
    assert len(jobs) <= 2
    assert write_counted(df.limit(0), str(tmp_path / "none"), {"a": F.col("form") == "a"}) == {"written": 0, "a": 0}


def test_sessions_close_by_timers_and_late_events_are_left_out(spark, tmp_path):
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    own.conf.set("spark.sql.session.timeZone", "UTC")
    at = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    steps = [
        [(1, at(0)), (1, at(20)), (2, at(5))],
        # joins what was apart: 45 lies between 20 and 70
        [(1, at(70)), (1, at(45)), (None, at(71)), (3, None)],
        [(None, at(71))],
        # late is what lies behind the watermark of the batch before, 61 minutes: 30 is, 62 is not
        [(2, at(30)), (2, at(62)), (None, at(400))],
        [(None, at(500))],
    ]
    path = str(tmp_path / "in")
    for rows in steps:
        own.createDataFrame(rows, "user_id long, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(path)
    stream = own.readStream.schema("user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    closed = stateful_sessions(stream, gap=timedelta(minutes=30))
    closed.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "notes")).trigger(availableNow=True).start().awaitTermination()
    rows = own.read.schema(closed.schema).parquet(str(tmp_path / "out")).selectExpr("user_id", "date_format(session_start, 'HH:mm')", "date_format(session_end, 'HH:mm')", "n").collect()
    assert sorted(map(tuple, rows)) == [(1, "00:00", "01:40", 4), (2, "00:05", "00:35", 1), (2, "01:02", "01:32", 1)]
