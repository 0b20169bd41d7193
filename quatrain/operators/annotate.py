"""Annotation projections: pre-labels, answers of a model, validation, resume, reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quatrain.functions import text as X

MODEL_DIMS = ("emotion", "diction", "expression", "energy")
MANY = "emotion"
MOST_EVIDENCE, MOST_LABELS = 3, 2


def dim_type(dim: str) -> str:
    return f"struct<value:{'array<string>' if dim == MANY else 'string'},confidence:double,evidence:array<string>,method:string,status:string>"


def pending(dim: str) -> Column:
    kind = "array<string>" if dim == MANY else "string"
    return F.struct(
        F.lit(None).cast(kind).alias("value"), F.lit(None).cast("double").alias("confidence"), F.array().cast("array<string>").alias("evidence"),
        F.lit(None).cast("string").alias("method"), F.lit("pending_llm").alias("status"),
    )


def with_rule_annotation(records: DataFrame, labels: DataFrame, version: str = "v1", id_col: str = "id") -> DataFrame:
    """labels: id, imagery, density. Adds column annotation (prelabel and review), and marks the metadata. Style stays as
    it is: weak labels never enter it. A blank text is an error."""
    joined = records.join(labels, id_col, "left")
    blank = ~F.coalesce(F.col("text").rlike("(?U)[^\\s\\x{1c}-\\x{1f}]"), F.lit(False))
    prelabel = F.struct("imagery", "density", *[pending(d).alias(d) for d in MODEL_DIMS])
    review = F.struct(F.lit("pending_human_review").alias("status"), F.lit("").alias("reviewer"), F.lit("").alias("notes"))
    errors = F.lit(None).cast("array<struct<stage:string,message:string>>")
    if "annotation" in records.columns:
        errors = F.col("annotation.errors")
    annotation = F.struct(F.when(blank, F.raise_error(F.concat(F.lit("blank text: "), F.coalesce(id_col, F.lit("null")))).cast("string")).otherwise(version).alias("version"), prelabel.alias("prelabel"), review.alias("review"), errors.alias("errors"))
    marked = F.col("metadata").withField("annotation_method", F.lit("hybrid_preannotation_v1")).withField("review_status", F.lit("preannotated_pending_review"))
    return joined.select(*[c for c in records.columns if c not in ("metadata", "annotation")], marked.alias("metadata"), annotation.alias("annotation"))


def is_complete(prelabel: Column) -> Column:
    """All of the model's dimensions carry labels; anything missing means no."""
    done = F.lit(True)
    for d in MODEL_DIMS:
        done = done & F.coalesce(prelabel[d]["status"] == "prelabeled", F.lit(False))
    return done


def resume(fresh: Column, old: Column) -> Column:
    """A fresh prelabel with the old one's finished dimensions. Same row, so nothing moves."""
    for d in MODEL_DIMS:
        kept = F.coalesce(old[d]["status"] == "prelabeled", F.lit(False))
        fresh = fresh.withField(d, F.when(kept, old[d]).otherwise(fresh[d]))
    return fresh


def pending_rows(df: DataFrame, complete: Column, order: str, most: int | None = 10) -> DataFrame:
    """The first rows, in order, that the model has not labelled; None for all."""
    if most is not None and most < 0:
        raise ValueError("the limit must not be negative")
    left = df.where(~complete)
    return left if most is None else left.orderBy(order).limit(most)


def validate_answer(answer: Column, text: Column, taxonomy: Mapping[str, Sequence[str]]) -> Column:
    """A model's answer (variant) against the taxonomy: struct of the dimensions, and error (null if it holds).

    Per dimension: an object; emotion a list of one or two distinct allowed labels, the others one; confidence a number
    from 0 to 1 and not a boolean; evidence (none if it is left out) up to three non-blank strings that stand in the text without its line ends.
    """
    flat = F.replace(text, F.lit("\n"), F.lit(""))

    def check(d: str, part: Column) -> Column:
        kind = lambda p: F.schema_of_variant(F.try_variant_get(part, p, "variant"))
        allowed = F.array(*[F.lit(v) for v in taxonomy[d]])
        if d == MANY:
            value = F.try_variant_get(part, "$.value", "array<string>")
            listed = F.coalesce(kind("$.value") == "ARRAY<STRING>", F.lit(False))
            good = listed & F.size(value).between(1, MOST_LABELS) & (F.size(F.array_distinct(value)) == F.size(value)) & (F.size(F.array_except(value, allowed)) == 0)
        else:
            value = F.try_variant_get(part, "$.value", "string")
            good = (kind("$.value") == "STRING") & F.array_contains(allowed, value)
        sure = F.try_variant_get(part, "$.confidence", "double")
        number = F.coalesce(kind("$.confidence").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & sure.between(0.0, 1.0), F.lit(False))
        absent = kind("$.evidence").isNull()
        proof = F.when(absent, F.array().cast("array<string>")).otherwise(F.transform(F.try_variant_get(part, "$.evidence", "array<string>"), X.strip))
        strings = absent | F.coalesce(kind("$.evidence").isin("ARRAY<STRING>", "ARRAY<VOID>", "ARRAY<NULL>"), F.lit(False))
        shaped = strings & (F.size(proof) <= MOST_EVIDENCE) & F.forall(proof, lambda p: p != "")
        found = F.forall(proof, lambda p: F.contains(flat, p))
        error = (
            F.when(~F.coalesce(F.schema_of_variant(part).startswith("OBJECT"), F.lit(False)), f"{d}: no object")
            .when(~F.coalesce(good, F.lit(False)), f"{d}: label not allowed")
            .when(~number, f"{d}: bad confidence")
            .when(~F.coalesce(shaped, F.lit(False)), f"{d}: bad evidence")
            .when(~F.coalesce(found, F.lit(False)), f"{d}: evidence not found in the text")
        )
        label = F.struct(value.alias("value"), F.bround(sure, 3).alias("confidence"), proof.alias("evidence"), F.lit("llm_weak_label_v1").alias("method"), F.lit("prelabeled").alias("status")).cast(dim_type(d))
        return F.struct(label.alias("label"), error.alias("error"))

    def whole(given: Column, dims: Column) -> Column:
        first = F.coalesce(F.when(given.isNull(), "no object"), *[dims[d]["error"] for d in MODEL_DIMS])
        return X.let(first, lambda error: F.struct(*[F.when(error.isNull(), dims[d]["label"]).alias(d) for d in MODEL_DIMS], error.alias("error")))

    # the answer, its parts and what is wrong are named many times each: without let they would be computed as many times
    parts = lambda given: F.struct(*[X.let(F.try_variant_get(given, f"$.{d}", "variant"), partial(check, d)).alias(d) for d in MODEL_DIMS])
    return X.let(answer, lambda given: X.let(parts(given), partial(whole, given)))


ERRORS = "array<struct<stage:string,message:string>>"


def with_error(errors: Column, message: Column) -> Column:
    """A record's errors with one more of the model's stage, cut to 1000 signs; as they are where there is no message."""
    old = F.coalesce(errors, F.array().cast(ERRORS))
    return F.when(message.isNull(), old).otherwise(F.concat(old, F.array(F.struct(F.lit("llm").alias("stage"), F.substring(message, 1, 1000).alias("message")))))


def apply_answers(df: DataFrame, answer_col: str, taxonomy: Mapping[str, Sequence[str]], prelabel_col: str = "prelabel", text_col: str = "text", failure_col: str | None = None) -> DataFrame:
    """Take a model's raw answers into the prelabel; what does not hold becomes one more error of the record instead, behind
    those of earlier runs. failure_col: messages of calls that failed. prelabel_col may stand inside a struct, as
    annotation.prelabel does; then the errors stand beside it."""
    path = prelabel_col.rsplit(".", 1)
    checked = df.withColumn("__checked", validate_answer(X.json_object_in(F.col(answer_col)), F.col(text_col), taxonomy))
    message = F.col("__checked.error") if failure_col is None else F.coalesce(F.col(failure_col), F.col("__checked.error"))
    held = df.select(F.col(prelabel_col).alias("p")).schema["p"].dataType.names
    label = F.struct(*[(F.when(message.isNull(), F.col(f"__checked.{d}")).otherwise(F.col(f"{prelabel_col}.{d}")) if d in MODEL_DIMS else F.col(f"{prelabel_col}.{d}")).alias(d) for d in held])
    if len(path) == 2:
        around = df.schema[path[0]].dataType.names
        now = {path[1]: label, "errors": with_error(F.col(f"{path[0]}.errors"), message)}
        return checked.withColumn(path[0], F.struct(*[now.get(c, F.col(f"{path[0]}.{c}")).alias(c) for c in around])).drop("__checked")
    old = F.col("errors") if "errors" in df.columns else F.lit(None).cast(ERRORS)
    return checked.withColumn(prelabel_col, label).withColumn("errors", with_error(old, message)).drop("__checked")


def ask_model(df: DataFrame, prompt_col: str, client: Callable[[str], str], answer_col: str = "answer") -> DataFrame:
    """Send prompts through a client that is passed in; a failure becomes an answer of null and its message. Other columns,
    nested ones too, pass through as they are."""
    import pyarrow as pa
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField(answer_col, T.StringType()), T.StructField("failure", T.StringType())])

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            answers, failures = [], []
            for prompt in batch.column(batch.schema.get_field_index(prompt_col)).to_pylist():
                try:
                    answers.append(client(prompt))
                    failures.append(None)
                except Exception as e:
                    answers.append(None)
                    failures.append(str(e)[:1000])
            fields = [*batch.schema, pa.field(answer_col, pa.string()), pa.field("failure", pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, pa.string()), pa.array(failures, pa.string())], schema=pa.schema(fields))

    return df.mapInArrow(run, schema)


def run_counts(df: DataFrame, success: Column, failure: Column, most: int | None = None) -> DataFrame:
    """One row: rows attempted by a run, how many succeeded and how many failed, whether the run stopped at its limit of
    attempts, and the rows that are left."""
    tried = success | failure
    out = df.agg(F.count_if(tried).alias("attempted"), F.count_if(success).alias("succeeded"), F.count_if(failure & ~success).alias("failed"), F.count_if(~tried).alias("left"))
    return out.withColumn("stopped", F.lit(False) if most is None else (F.col("attempted") >= most) & (F.col("left") > 0))


def form_report(df: DataFrame, form: str = "form", entity: str = "author") -> DataFrame:
    """One row per form and one for all (form null): rows and distinct entities. One aggregate over grouping sets."""
    return df.rollup(form).agg(F.count("*").alias("n_rows"), F.count_distinct(entity).alias("n_entities"))


def diversity(df: DataFrame, form: str = "form", entity: str = "author") -> DataFrame:
    """Entities, those in more than one form, and most rows of one of them (0 if there are none)."""
    per = df.groupBy(entity).agg(F.count("*").alias("n"), F.count_distinct(form).alias("forms"))
    return per.agg(F.count("*").alias("n_entities"), F.count_if(F.col("forms") > 1).alias("n_in_several"), F.coalesce(F.max("n"), F.lit(0)).alias("most_rows"))


def annotation_report(df: DataFrame, imagery: str, density: str, complete: Column, domain: Sequence[str] = ("sparse", "medium", "dense")) -> DataFrame:
    """One row: records, those without imagery, complete ones, and density counts over a fixed domain, zeros included."""
    counts = [F.count_if(F.col(density) == v).alias(f"density_{v}") for v in domain]
    return df.agg(F.count("*").alias("n_rows"), F.count_if(F.size(imagery) == 0).alias("imagery_empty"), F.count_if(complete).alias("llm_complete"), *counts)


def run_report(records: DataFrame, version: str = "v1", attempted: int = 0, succeeded: int = 0, failed: int = 0, domain: Sequence[str] = ("sparse", "medium", "dense")) -> DataFrame:
    """One row about annotated records, nested as it is written: version, number, what the rules gave (records without
    imagery, counts of its labels and of density over a fixed domain), what the model gave in all and in this run, and that
    neither style nor gold is touched. One aggregate, with labels counted on the way."""
    label = F.col("annotation.prelabel")
    per = records.select(label.alias("p"), F.coalesce(label["imagery"]["value"], F.array().cast("array<string>")).alias("i"))
    labels = per.select(F.explode("i").alias("k")).groupBy("k").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias("labels"))
    counts = per.agg(
        F.count("*").alias("records"), F.count_if(F.size("i") == 0).alias("empty"), F.count_if(is_complete(F.col("p"))).alias("complete"),
        *[F.count_if(F.col("p.density.value") == v).alias(f"density_{v}") for v in domain],
    )
    # one row each
    both = counts.withColumn("__one", F.lit(1)).join(labels.withColumn("__one", F.lit(1)), "__one")
    density = F.create_map(*[x for v in domain for x in (F.lit(v), F.col(f"density_{v}"))])
    return both.select(
        F.lit(version).alias("annotation_version"), "records",
        F.struct(F.lit("lexicon_longest_match_v1").alias("method"), F.col("empty").alias("imagery_empty"), F.col("labels").alias("imagery_label_counts"), density.alias("density_label_counts")).alias("rules"),
        F.struct(
            F.lit("llm_weak_label_v1").alias("method"), F.col("complete").alias("complete_records"), F.lit(attempted).cast("long").alias("attempted_this_run"),
            F.lit(succeeded).cast("long").alias("success_this_run"), F.lit(failed).cast("long").alias("failed_this_run"),
        ).alias("llm"),
        F.lit("candidate_only_until_human_review").alias("gold_status"), F.lit(False).alias("style_fields_modified"),
    )


def label_counts(df: DataFrame, labels: str) -> DataFrame:
    return df.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
