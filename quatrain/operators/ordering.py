"""Positions of rows in one order of a whole table, without gathering the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quatrain.sources.scratch import materialize

#: Bits of monotonically_increasing_id() that count within a partition.
WITHIN = (1 << 33) - 1


def number_rows(df: DataFrame, order: Sequence[str | Column], name: str = "n", parts: int | None = None) -> DataFrame:
    """df with a column of positions 1, 2, ... in the given order (rows that tie in all of it come in any order).

    Rows are dealt to ranges of the order, sorted and counted within their range, and written; a range's rows begin behind
    those of all ranges before it. Only the ranges' counts, one row each, ever meet in one task, and a lost executor
    costs its own ranges. An order whose first columns tie in many rows needs further columns, which are dealt by as well.
    An empty table stays empty.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = ranges.withColumn("__range", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit(WITHIN)))
    placed, _ = materialize(placed, "numbered")
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("__range").agg(F.count("*").alias("__size"))
    begins = counts.select("__range", F.coalesce(F.sum("__size").over(ahead), F.lit(0)).alias("__begin"))
    numbered = placed.join(F.broadcast(begins), "__range")
    return numbered.select(*df.columns, (F.col("__begin") + F.col("__at") + 1).alias(name))


def number_within(df: DataFrame, groups: Sequence[str], order: Sequence[str | Column], name: str = "n") -> DataFrame:
    """df with positions 1, 2, ... within each group of equal values (nulls are a group), in the given order. A group of any
    size is numbered by all tasks that its rows are dealt to: its positions in the whole less where the group begins."""
    placed, _ = materialize(number_rows(df, [*groups, *order], "__n"), "placed")
    begins = placed.groupBy(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)]).agg((F.min("__n") - 1).alias("__begin"))
    same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)]
    return placed.join(begins, same).select(*df.columns, (F.col("__n") - F.col("__begin")).alias(name))
