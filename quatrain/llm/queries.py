"""The opN_ queries: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quatrain.llm.line_dedup import SPREAD_SQL
from quatrain.llm.resample import RESAMPLE_SQL
from quatrain.llm.warc import ROUNDTRIP_SQL

MODEL = "piece_bpe_32k.model"

Query = Callable[[SparkSession, str], DataFrame]


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quatrain.llm.token_count import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), model_path())


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quatrain.llm.warc import archive_roundtrip

    return archive_roundtrip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_pfp_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quatrain.llm.pfp import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op4_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quatrain.llm.golay import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quatrain.llm.quality import quality_verdicts

    out = quality_verdicts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_cgk_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quatrain.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quatrain.llm.credentials import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op8_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quatrain.llm.line_dedup import remove_spread_lines

    out = remove_spread_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_html_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quatrain.llm.html_extract import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quatrain.llm.spm_fst import encode_texts

    return encode_texts(table(spark, sf_dir, "documents"), model_path())


def op11_language_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quatrain.llm.language import identify_languages

    return identify_languages(table(spark, sf_dir, "documents"), model_path())


def op12_tsqr_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quatrain.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quatrain.llm.resample import importance_resample

    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_warc_archive": op2_warc_archive,
    "op3_pfp_repeats": op3_pfp_repeats,
    "op4_simhash_golay": op4_simhash_golay,
    "op5_quality_mcd": op5_quality_mcd,
    "op6_cgk_leaks": op6_cgk_leaks,
    "op7_secret_links": op7_secret_links,
    "op8_line_spread": op8_line_spread,
    "op9_html_suffix_array": op9_html_suffix_array,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_language_unigrams": op11_language_unigrams,
    "op12_tsqr_whitening": op12_tsqr_whitening,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc_archive": ROUNDTRIP_SQL,
    "op8_line_spread": SPREAD_SQL,
    "op13_importance_resampling": RESAMPLE_SQL,
}
