"""Structural forms, candidates, keep-first dedup and records."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quatrain.functions import text as X


@dataclass(frozen=True)
class Form:
    """So many lines, each of which matches the pattern."""

    name: str
    n_lines: int
    line_pattern: str


SEVEN = f"^{X.HAN}{{7}}\\z"
TANG_FORMS = (Form("qijue7", 4, SEVEN), Form("qilv7", 8, SEVEN))


def _matches(pattern: str):
    return lambda x: x.rlike(pattern)


def detect_form(lines: Column, forms: Sequence[Form] = TANG_FORMS) -> Column:
    out = F.lit(None).cast("string")
    for f in reversed(forms):
        fits = F.coalesce(F.forall(lines, _matches(f.line_pattern)), F.lit(False))
        out = F.when((F.size(lines) == f.n_lines) & fits, f.name).otherwise(out)
    return out


def with_form(df: DataFrame, lines_col: str = "lines", forms: Sequence[Form] = TANG_FORMS, allowed: Sequence[str] | None = None) -> DataFrame:
    """Rows whose lines have an allowed form, with column form. Comes before any dedup, so dedup shuffles less."""
    named = df.withColumn("form", detect_form(F.col(lines_col), forms))
    return named.where(F.col("form").isin(*(allowed or [f.name for f in forms])))


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order; one shuffle by key, and Spark keeps one row a key before it."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def limited(df: DataFrame, order: Sequence[str], most: int | None) -> DataFrame:
    """The first rows in order. The limit is looked at after a row has been taken, so 0 still gives one."""
    return df if most is None else df.orderBy(*order).limit(max(most, 1))


BLANK_STYLE = (
    "named_struct('emotion', cast(array() as array<string>), 'imagery', cast(array() as array<string>), "
    "'diction', '', 'expression', '', 'energy', '', 'density', '')"
)


def to_records(candidates: DataFrame, constants: dict[str, str]) -> DataFrame:
    """source_id, title, author, source_file, form, lines to annotation records; constants fill further metadata."""
    text = F.array_join("lines", "\n")
    known = {"dynasty", "source", "collection", "source_url", "source_license", "script", "form_detection"}
    if set(constants) != known:
        raise ValueError(f"constants needed: {sorted(known)}")
    c = {k: F.lit(v) for k, v in constants.items()}
    metadata = F.struct(
        "title", "author", c["dynasty"].alias("dynasty"), c["source"].alias("source"), c["collection"].alias("collection"), "source_id", "source_file",
        c["source_url"].alias("source_url"), c["source_license"].alias("source_license"), c["script"].alias("script"), c["form_detection"].alias("form_detection"),
        F.lit("style_unlabeled").alias("annotation_method"), F.lit("unreviewed").alias("review_status"),
    )
    return candidates.select(
        X.stable_id(F.col("source_id"), text).alias("id"), text.alias("text"), "form", F.expr(BLANK_STYLE).alias("style"),
        F.struct(F.lit(None).cast("int").alias("adaptation")).alias("culture"), metadata.alias("metadata"),
    )


def record_violations(records: DataFrame, allowed: Sequence[str], order: str, fields: Sequence[str] = ("id", "text", "form", "style", "culture", "metadata")) -> DataFrame:
    """order and reason of records that lack a field or have an unknown form."""
    missing = F.filter(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) if f in records.columns else F.lit(f) for f in fields]), lambda x: x.isNotNull())
    reason = F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ","))).when(~F.coalesce(F.col("form").isin(*allowed), F.lit(False)), F.concat(F.lit("unknown form "), F.coalesce("form", F.lit("null"))))
    return records.select(order, reason.alias("reason")).where("reason is not null")
