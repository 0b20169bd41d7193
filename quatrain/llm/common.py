"""Helpers that the training-data operators share: Arrow mapping of texts, and scratch tables on shared storage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quatrain.sources.scratch import discard, materialize, scratch_dir, scratch_path

__all__ = ["discard", "map_texts", "materialize", "scratch_dir", "scratch_path", "text_or_empty"]


def text_or_empty(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def map_texts(
    df: DataFrame,
    keep: list[str],
    text,
    make: Callable[[], Callable[[list[str]], list[pa.Array]]],
    fields: list[T.StructField],
) -> DataFrame:
    """Per-row Python over Arrow batches: make() runs once a task and gives a function from texts to new columns.

    Nulls count as empty texts. Columns in keep pass through unchanged; other columns are not read.
    """
    source = df.select(*[F.col(c) for c in keep], text.alias("__text"))
    schema = T.StructType([source.schema[c] for c in keep] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                made = work([x or "" for x in part.column(len(keep)).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + made, names=schema.names)

    return source.mapInArrow(run, schema)
