"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination and encoding, each on what is left.

Defined results: a null or empty text fails the quality rules; other columns may be null and stay so; of repeated rows one
stays (they are copies); of copies the smallest id stays, a null id only where all of a group are null; very long texts
are treated like any other; an empty table gives an empty table; columns beyond those of documents are not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quatrain.llm.common import materialize
from quatrain.llm.decontaminate import mark_leaks
from quatrain.llm.golay import one_of_each
from quatrain.llm.line_dedup import remove_spread_lines
from quatrain.llm.quality import quality_verdicts
from quatrain.llm.queries import model_path
from quatrain.llm.similar import similar_texts
from quatrain.llm.spm_fst import encode_texts

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of the shortest benchmark items that documents are dropped for.
LEAST_ITEM_WORDS = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within the estimates of their language and source."""
    return quality_verdicts(docs, keep=COLUMNS).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that spread over many sources; proven copies of a document stay whole for near_dedup."""
    cut = remove_spread_lines(docs, keep=("lang", "source"))
    return cut.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates (5-word shingles, similarity 0.8 or more)."""
    return one_of_each(docs, columns=COLUMNS, find=similar_texts)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaked; an item of a few words would be a phrase of many clean documents."""
    marked = mark_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=COLUMNS, least_words=LEAST_ITEM_WORDS)
    return marked.where(F.size("leaks") == 0).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents, and the texts decoded from them."""
    return encode_texts(docs, model_path(), keep=("doc_id", "lang", "source"), decoded_col="text")


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: Estimates, fingerprints and walks have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
