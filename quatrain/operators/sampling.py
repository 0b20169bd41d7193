"""Balanced samples: equal chances for entities, exact targets, reproducible by seed."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quatrain.operators.ordering import number_within


def chance(seed: int, *columns: str) -> Column:
    """A reproducible random key: the same in any engine that has MD5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def capacity(df: DataFrame, stratum: str, entity: str, most: int = 1) -> DataFrame:
    """Per stratum: rows, entities and capacity, the rows left if an entity may give so many at most."""
    per = df.groupBy(stratum, entity).agg(F.count("*").alias("n"))
    return per.groupBy(stratum).agg(F.sum("n").alias("rows"), F.count("*").alias("entities"), F.sum(F.least("n", F.lit(most))).alias("capacity"))


def balanced_sample(df: DataFrame, stratum: str, entity: str, row_id: str, targets: Mapping[str, int], seed: int, most: int = 1, check: bool = True) -> DataFrame:
    """So many rows of each stratum, in rounds over shuffled entities, and column annotation_pos, a shuffled order.

    Row keys and entity keys are hashes, so tasks agree on the order without a shared random stream. Raises ValueError for
    a bad target or one beyond the capacity.
    """
    if most < 1 or any(n < 0 for n in targets.values()):
        raise ValueError("targets must be 0 or more, and rows an entity 1 or more")
    wanted = {k: n for k, n in targets.items() if n}
    if check and wanted:
        there = {r[stratum]: r["capacity"] for r in capacity(df.where(F.col(stratum).isin(*wanted)), stratum, entity, most).collect()}
        for k, n in wanted.items():
            if there.get(k, 0) < n:
                raise ValueError(f"target {n} of {k} is beyond the capacity {there.get(k, 0)}")
    own = Window.partitionBy(stratum, entity).orderBy("__row", row_id)
    taken = df.where(F.col(stratum).isin(*wanted)).withColumn("__row", chance(seed, row_id)).withColumn("__round", F.row_number().over(own)).where(F.col("__round") <= most)
    turn = Window.partitionBy(stratum).orderBy("__round", chance(seed, entity), entity)
    target = F.coalesce(*[F.when(F.col(stratum) == k, n) for k, n in wanted.items()]) if wanted else F.lit(0)
    chosen = taken.withColumn("__turn", F.row_number().over(turn)).where(F.col("__turn") <= target)
    # the sample is as large as the targets say, so one task may number it
    pos = F.row_number().over(Window.orderBy(chance(seed + 997, row_id), row_id))
    return chosen.withColumn("annotation_pos", pos).drop("__row", "__round", "__turn")


def exact_sample(
    df: DataFrame, stratum: str, entity: str, row_id: str, targets: Mapping[str, int], seed: int, most: int = 1, offsets: Mapping[str, int] | None = None, order: str | None = None, shuffle_offset: int = 997
) -> DataFrame:
    """The rows that a sequential program draws with Python's own random stream, and annotation_pos, their shuffled order.

    Each stratum has a stream seeded with seed and its offset. Fixed order of draws: the sorted entities are shuffled; then
    each entity's rows, in the given order (row_id by default), entity by entity; then, every round anew, a copy of the
    once-shuffled entities, and each gives its next row until the target is reached. The rows drawn, in order of strata,
    are shuffled with a stream of their own.

    How a stream runs hangs on the entities and on how many rows each has, not on the rows: it is run over those counts, and
    gives the places, within their entity, of the rows drawn. Rows are numbered within their entities across tasks and
    joined to the places, so no task holds a stratum's ids; the shuffled order is one of as many numbers as the targets ask
    for. Raises ValueError for a target beyond the capacity; repeated ids fail when the sample is read. For samples
    without a sequential stream see balanced_sample."""
    wanted = [k for k, n in targets.items() if n]
    if not wanted:
        return df.where("false").withColumn("annotation_pos", F.lit(0))
    own = df.where(F.col(stratum).isin(*wanted))
    counts = own.groupBy(F.col(stratum).alias("s"), F.col(entity).alias("e")).agg(F.count("*").alias("n"))
    begins, begin = {}, 0
    for k in wanted:
        begins[k], begin = begin, begin + targets[k]
    drawn = counts.groupBy("s").applyInPandas(_draw(dict(targets), seed, dict(offsets or {}), most), f"s string, e {df.schema[entity].dataType.simpleString()}, place long, n int")
    order_of = list(range(begin))
    _shuffle(order_of, seed + shuffle_offset)
    positions = df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(order_of, 1)], "x int, annotation_pos int")
    first = F.coalesce(*[F.when(F.col("s") == k, F.lit(n)) for k, n in begins.items()])
    placed = drawn.withColumn("x", first + F.col("n")).join(positions, "x").select("s", "e", "place", "annotation_pos")
    ranked = number_within(own, [stratum, entity], [order or row_id] + ([row_id] if order else []), "__place")
    chosen = ranked.join(placed, (F.col(stratum) == F.col("s")) & F.col(entity).eqNullSafe(F.col("e")) & (F.col("__place") == F.col("place")))
    # the sample is as large as the targets say
    again = F.count("*").over(Window.partitionBy(row_id)) > 1
    checked = F.when(again, F.raise_error(F.concat(F.lit("the sample repeats the id "), F.coalesce(F.col(row_id).cast("string"), F.lit("null")))).cast("int")).otherwise(F.col("annotation_pos"))
    return chosen.withColumn("annotation_pos", checked).select(*df.columns, "annotation_pos")


def _shuffle(values: list, seed: int) -> None:
    import random

    random.Random(seed).shuffle(values)


def _draw(targets: dict, seed: int, offsets: dict, most: int):
    import random

    import pandas as pd

    def run(counts: pd.DataFrame) -> pd.DataFrame:
        name = counts["s"].iloc[0]
        stream, target = random.Random(seed + offsets.get(name, 0)), targets[name]
        sizes = dict(sorted(zip(counts["e"], counts["n"], strict=True), key=lambda x: (x[0] is not None, x[0])))
        entities = list(sizes)
        stream.shuffle(entities)
        first = {}
        for e in entities:
            places = list(range(1, sizes[e] + 1))
            stream.shuffle(places)
            first[e] = places[:most]
        picked = []
        for k in range(most):
            turn = list(entities)
            stream.shuffle(turn)
            picked += [(e, first[e][k]) for e in turn if k < len(first[e])]
        picked = picked[:target]
        if len(picked) < target:
            raise ValueError(f"target {target} of {name} is beyond the capacity {len(picked)}")
        return pd.DataFrame({"s": name, "e": [e for e, _ in picked], "place": [p for _, p in picked], "n": range(len(picked))})

    return run


def tag_sample(records: DataFrame, seed: int, targets: Mapping[str, int], most: int, version: str = "v1") -> DataFrame:
    """Records marked as sampled and pending; style stays as it is."""
    sampling = F.struct(
        F.lit(version).alias("sample_version"), F.lit("author_balanced_round_robin").alias("method"), F.lit(seed).cast("long").alias("seed"),
        F.coalesce(*[F.when(F.col("form") == k, n) for k, n in targets.items()]).cast("int").alias("form_target"), F.lit(most).alias("max_per_author_per_form"),
    )
    marked = F.col("metadata").withField("review_status", F.lit("pending_annotation")).withField("annotation_method", F.lit("unlabeled")).withField("sampling", sampling)
    return records.withColumn("metadata", marked)


def duplicate_ids(df: DataFrame, row_id: str) -> DataFrame:
    return df.groupBy(row_id).agg(F.count("*").alias("n")).where("n > 1")
