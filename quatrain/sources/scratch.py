"""Intermediate tables on the storage that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

_own_scratch: list[str] = []
_written: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a folder of our own only where it is unset and Spark
    runs in one process. On a cluster without it an error is raised, since executors would write to their own disks."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_scratch:
        _own_scratch.append("file://" + tempfile.mkdtemp(prefix="quatrain-"))
    return _own_scratch[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/quatrain-{name}-{uuid.uuid4().hex}"
    _written.add(path)
    return path


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> tuple[DataFrame, str]:
    """Write df as Parquet to the shared folder and read it again: lineage ends there, lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    schema = df.schema
    return spark.read.schema(schema).parquet(path), path


def discard(*paths: str) -> None:
    """Delete scratch tables that no later step reads. A store that pyarrow has no client for keeps them until its folder
    is cleaned."""
    for p in paths:
        _written.discard(p)
        try:
            store, where = pa.fs.FileSystem.from_uri(p)
            store.delete_dir(where)
        except (OSError, pa.ArrowException):
            continue


@atexit.register
def _discard_rest() -> None:
    """What results still read goes when the driver ends."""
    discard(*list(_written))
    for d in _own_scratch:
        shutil.rmtree(d.removeprefix("file://"), ignore_errors=True)
