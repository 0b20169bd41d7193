"""Labelling by a model in micro-batches that can be stopped at any time and taken up again."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quatrain.operators import annotate
from quatrain.operators.prompts import label_prompt

LABEL = "annotation.prelabel"


def label_in_batches(
    spark: SparkSession, source: str, out: str, checkpoint: str, client: Callable[[str], str], taxonomy: Mapping[str, Mapping[str, str] | Sequence[str]], files_per_batch: int = 1, prompt: Column | None = None
) -> dict[str, int]:
    """Label the annotated records (text, annotation, further columns) of the Parquet files in `source`, some files at a
    time, and give the counts of this call: attempted, succeeded, failed.

    Each batch of files is asked, checked and written to a folder of its own number in `out`, which is overwritten as a
    whole if that batch is run again; the checkpoint then notes it as done. After a crash the next call goes on with the
    first batch that is not: no record of a finished batch is asked twice, and none is written twice. Records that have all
    labels are not asked. Errors are added to those that a record has, so `out` of one run may be the `source` of the
    next. One that failed keeps its place and its pending labels."""
    values = {d: list(v) for d, v in taxonomy.items()}
    totals: Counter = Counter({"attempted": 0, "succeeded": 0, "failed": 0})

    def commit(batch: DataFrame, number: int) -> None:
        done = annotate.is_complete(F.col(LABEL))
        left = batch.where(~done).withColumn("__prompt", label_prompt(F.col("text"), taxonomy) if prompt is None else prompt)
        asked = annotate.ask_model(left, "__prompt", client, "__answer")
        labelled = annotate.apply_answers(asked, "__answer", values, LABEL, failure_col="failure").select(*batch.columns)
        seen = Observation()
        good = annotate.is_complete(F.col(LABEL))
        counted = labelled.observe(seen, F.count(F.lit(1)).alias("attempted"), F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"))
        batch.where(done).unionByName(counted).write.mode("overwrite").parquet(f"{out}/batch={number:06d}")
        totals.update(dict(seen.get))

    schema = spark.read.parquet(source).drop("batch").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).parquet(source)
    run = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return dict(totals)
