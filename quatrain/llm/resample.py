"""Draw documents like a target by importance resampling of hashed word features.

Features are all runs of one to n consecutive words. Each falls into one of a fixed number of buckets (CRC32 of its
UTF-8 bytes), and a bucket's gain is the scaled logarithm of its smoothed share in the target over that in the corpus. A
document's weight is the sum of its features' gains; Gumbel noise that hangs on its id alone is added, and the highest
scores are a draw without replacement by weight.

Long texts are cut at word boundaries into chunks of at most chunk_words words, which carry the next n-1 words besides. A
chunk owns the features that start at its own words, so each feature of the text is counted by exactly one chunk, and
counts and weights of the chunks are summed by document.

Scale: texts are read once. Per chunk only its buckets with their counts are written; the corpus's counts are sums over
those with partial aggregation, at most one row a bucket. The gains, one number a bucket, are all that the driver holds.
Ranks come from ranges of the scores and prefix sums of their counts.

Defined results: a null or empty text has no words, no features and weight 0; a null id counts as the empty string in the
noise; repeated rows are documents of their own, and of equal scores of one id any comes first; very long texts are
counted whole; an empty corpus gives an empty table, and an empty target counts nothing; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quatrain.llm.common import materialize, text_or_empty
from quatrain.operators.ordering import number_rows

BUCKETS = 10_000
CHUNK_WORDS = 8192
#: Fixed by the contract of the query: longest run, share that is drawn, words of a document that may be drawn, seed.
LONGEST, SHARE, LEAST_WORDS, SEED = 1, (10, 100), 20, 2024

#: Bytes that stand between words: ASCII but digits and letters.
_BETWEEN = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
_BLANK = bytes.maketrans(_BETWEEN, b" " * len(_BETWEEN))


def words_of(text: str) -> list[bytes]:
    """bytes.lower() changes A-Z only; bytes above ASCII belong to words."""
    return text.encode("utf-8").lower().translate(_BLANK).split(b" ")


def chunks_of(text: str, longest: int, chunk_words: int) -> Iterator[tuple[list[bytes], int]]:
    """(words, how many of them the chunk owns); a text without words is one chunk of none."""
    words = [w for w in words_of(text) if w]
    for at in range(0, max(1, len(words)), chunk_words):
        own = words[at : at + chunk_words]
        yield words[at : at + chunk_words + longest - 1], len(own)


def feature_counts(words: list[bytes], own: int, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features that start at the chunk's own words, and their counts."""
    found = Counter(words[:own])
    for n in range(2, longest + 1):
        found.update(b" ".join(words[i : i + n]) for i in range(min(own, len(words) - n + 1)))
    if not found:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    at = np.fromiter(map(zlib.crc32, found), np.int64, len(found)) % buckets
    sums = np.bincount(at, np.fromiter(found.values(), np.float64, len(found)), buckets)
    there = np.flatnonzero(sums)
    return there.astype(np.int32), sums[there].astype(np.int32)


def chunk_features(df: DataFrame, text_col: str, id_cols: list[str], longest: int, buckets: int, chunk_words: int) -> DataFrame:
    """One row a chunk: id columns, n_words (its own), n_features, buckets and counts."""
    source = df.select(*id_cols, text_or_empty(text_col).alias("__body"))
    kinds = ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in id_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(id_cols))
            for start in range(0, batch.num_rows, 1024):
                rows, words, where, counts = [], [], [], []
                for i in range(start, min(start + 1024, batch.num_rows)):
                    for chunk, own in chunks_of(texts[i].as_py() or "", longest, chunk_words):
                        b, c = feature_counts(chunk, own, longest, buckets)
                        rows.append(i)
                        words.append(own)
                        where.append(b)
                        counts.append(c)
                ends = pa.array(np.concatenate([[0], np.cumsum([len(b) for b in where])]).astype(np.int32))
                held = [batch.column(k).take(pa.array(rows)) for k in range(len(id_cols))]
                yield pa.RecordBatch.from_arrays(
                    [*held, pa.array(words, pa.int64()), pa.array([int(c.sum()) for c in counts], pa.int64()), *(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (where, counts))],
                    names=[*id_cols, "n_words", "n_features", "buckets", "counts"],
                )

    return source.mapInArrow(run, f"{kinds}, n_words long, n_features long, buckets array<int>, counts array<int>")


def bucket_counts(chunks: DataFrame) -> DataFrame:
    """(bucket, n) of all chunks."""
    each = chunks.select(F.inline(F.arrays_zip("buckets", "counts")))
    return each.groupBy(F.col("buckets").alias("bucket")).agg(F.sum("counts").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """A bucket's gain, from counts of at most one row a bucket."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for into, counts in ((s, corpus), (t, target)):
        for r in counts.collect():
            into[r["bucket"]] = r["n"]
    every_s, every_t = float(s.sum()), float(t.sum())
    return np.array([math.floor(1000 * math.log((y + 1) * (every_s + buckets) / ((x + 1) * (every_t + buckets)))) for x, y in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def _weighed(chunks: DataFrame, held: list[str], gain: np.ndarray) -> DataFrame:
    """held columns, n_words, n_features and weight of each chunk."""
    source = chunks.select(*held, "n_words", "n_features", "buckets", "counts")
    kinds = ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, counts = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            each = gain[where.flatten().to_numpy()] * counts.flatten().to_numpy().astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(each)])
            ends = np.concatenate([[0], np.cumsum(where.value_lengths().to_numpy())])
            weights = upto[ends[1:]] - upto[ends[:-1]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(weights, pa.int64())], names=[*held, "n_words", "n_features", "weight"])

    return source.mapInArrow(run, f"{kinds}, n_words long, n_features long, weight long")


def importance_resample(
    df: DataFrame,
    target: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    target_text_col: str = "text",
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    share: tuple[int, int] = SHARE,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    chunk_words: int = CHUNK_WORDS,
) -> DataFrame:
    """Every row's id, n_features, weight, score and rank (1, 2, ... by falling score, ties to the smaller id), null for
    rows that are not drawn. Of the N rows with at least least_words words, share[0] * N / share[1] are drawn, rounded down."""
    source = df.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col).alias("__id"), F.col(text_col).alias("__t"))
    # written at once, so a row keeps its number; all that follows reads counts instead of texts
    chunks, _ = materialize(chunk_features(source, "__t", ["__row", "__id"], longest, buckets, chunk_words), "features")
    wanted = chunk_features(target.select(F.lit(0).alias("__row"), F.col(target_text_col).alias("__t")), "__t", ["__row"], longest, buckets, chunk_words)
    gain = gains(bucket_counts(chunks), bucket_counts(wanted), buckets)
    rows = _weighed(chunks, ["__row", "__id"], gain).groupBy("__row", "__id").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")])
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("__id").cast("string"), F.lit(""))), 256), 1, 8)
    chance = (F.conv(head, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    scored = rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(chance))))
    scored, _ = materialize(scored, "scored")
    n = scored.where(F.col("n_words") >= least_words).count()
    most = share[0] * n // share[1]
    ranked = number_rows(scored.where(F.col("n_words") >= least_words), [F.col("score").desc(), F.col("__id").asc()], "rank")
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select(F.col("__id").alias(id_col), "n_features", "weight", "score", F.when(F.col("rank") <= most, F.col("rank")).alias("rank"))


#: CRC32 by bytes: a table of 256 entries made by its rule, then one step a byte; the rest is plain aggregation.
RESAMPLE_SQL = f"""
WITH RECURSIVE bits(k, c, step) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT k, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8
), crc AS (
  SELECT list(c ORDER BY k) AS tab FROM bits WHERE step = 8
), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark
), dw AS (
  SELECT r, w, count(*) AS n FROM (SELECT r, unnest(w) AS w FROM d) GROUP BY r, w
), words AS (
  SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM b)
), hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h), 2), lambda i: ('0x' || substr(h, i + 1, 2))::BIGINT)),
    lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT w, hex(encode(w)) AS h FROM words), crc
), s AS (
  SELECT bucket, sum(n)::DOUBLE AS s FROM dw JOIN hashed USING (w) GROUP BY bucket
), t AS (
  SELECT bucket, count(*)::DOUBLE AS t FROM b JOIN hashed USING (w) GROUP BY bucket
), g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS}) / ((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS}))))::BIGINT AS gain
  FROM (SELECT DISTINCT bucket FROM hashed) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
), weights AS (
  SELECT r, sum(n * gain)::BIGINT AS weight FROM dw JOIN hashed USING (w) JOIN g USING (bucket) GROUP BY r
), scored AS (
  SELECT r, doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (r)
), ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST_WORDS}
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {SHARE[0]} * n // {SHARE[1]} THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)
"""
