"""Pronunciations of rhyme feet from a table of any size, phrases before single signs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quatrain.functions import text as X
from quatrain.sources.scratch import materialize

#: Parts that the rows of a frequent foot are dealt to, so that no task joins them all.
SALT = 8


def with_sounds(df: DataFrame, table: DataFrame, text_col: str = "text", positions: Sequence[int] = (2, 4, 6, 8), longest: int = 4, out: str = "sounds") -> DataFrame:
    """df with a map from 1-based positions of lines to (final, tone, syllable) of the line's last sign, for
    scoring.JoinedSounds. table: (phrase, final, tone, syllable); the longest phrase of up to `longest` signs that the clean
    line ends with tells how its last sign is read, so signs with several readings follow the phrase they stand in.

    The feet of all lines are exploded with every ending they have, joined to the table by equality, and put back by row;
    of the table only phrases that occur are moved to the feet. Of a phrase that the table repeats the least row counts. Lines
    that end in no known phrase, or that are missing or empty, have no entry. Rows may repeat."""
    rows, _ = materialize(df.withColumn("__row", F.monotonically_increasing_id()), "rows")
    endings = [
        F.struct(F.lit(p).alias("place"), F.when(F.length(F.get("__lines", F.lit(p - 1))) >= k, F.right(F.get("__lines", F.lit(p - 1)), F.lit(k))).alias("phrase"))
        for p in positions
        for k in range(1, longest + 1)
        if p > 0
    ]
    lines = rows.select("__row", X.clean_lines(F.col(text_col)).alias("__lines"))
    feet = lines.select("__row", F.explode(F.array(*endings)).alias("f")).select("__row", "f.place", "f.phrase").where("phrase is not null")
    told = table.groupBy("phrase").agg(F.min(F.struct("final", "tone", "syllable")).alias("s"))
    known = told.join(feet.select("phrase").distinct(), "phrase", "left_semi")
    dealt = known.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    heard = feet.withColumn("__salt", F.pmod("__row", F.lit(SALT)).cast("int")).join(dealt, ["phrase", "__salt"])
    best = heard.groupBy("__row", "place").agg(F.max_by("s", F.length("phrase")).alias("s"))
    by_row = best.groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("place", "s"))).alias(out))
    return rows.join(by_row, "__row", "left").select(*df.columns, out)
