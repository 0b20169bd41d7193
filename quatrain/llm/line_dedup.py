"""Removal of lines that spread over many sites, in DataFrame operations only.

A line counts as boilerplate if it stands in documents of at least min_sites distinct sites. Sites are counted by
HyperLogLog sketches per line hash, which tasks build over their own rows and merge. Estimates that are too near to the
threshold to trust are settled by exact distinct counts of those lines alone. A boilerplate line is removed from every
document but those with the smallest id that holds it, so what copies share survives once.

Copies of a document share their lines, and cutting them would leave shreds that document deduplication no longer knows as
copies. A document is proven to be a copy of another, and left whole, by likeness: the sets of their five-word shingles
(words between ASCII blanks, A-Z lower-cased; a shorter text is one shingle) have a Jaccard similarity of OVER / UNDER or
more. Only documents whose spread lines from one keeper make up more than a COPY_SHARE-th of both texts are compared with it.
Every other document loses its spread lines, whatever share of its text they are.

Lines are the parts between line breaks; only lines with a word count, and they are compared whole (by 128 bits of their
SHA-256). Line breaks between the lines that stay are kept.

Scale: only hashes are exploded and aggregated, with partial aggregation, so a line that a third of all documents hold
sends one sketch a task. Texts move once, to meet the places to cut.

Defined results: null and empty texts have no lines and stay as they are; null sites count together as one site, and
lines of documents with a null id are removed if another id holds them; repeated rows get equal rows; an empty table
gives an empty table; further columns pass through if asked for. Very long texts are treated like any other; cutting takes
time in proportion to a text's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quatrain.llm.common import materialize

MIN_SITES = 8
COPY_SHARE = 3
SHINGLE, OVER, UNDER = 5, 4, 5
#: Binary logarithm of the number of sketch registers, and the relative standard error it gives.
REGISTERS = 12
ERROR = 1.04 / 2 ** (REGISTERS / 2)
#: Estimates within so many standard errors of the threshold are counted exactly.
WIDTH = 4


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_spread(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """Boilerplate lines: line (hash), sites (estimate, or exact near the threshold) and keeper (smallest id)."""
    lines = _occurrences(df, text_col, id_col, site_col).select("line", "id", "site")
    return _spread(lines, min_sites)


def _occurrences(df: DataFrame, text_col: str, id_col: str, site_col: str) -> DataFrame:
    source = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.col(text_col).cast("string").alias("t"))
    each = source.select("id", "version", "site", F.length("t").alias("size"), F.posexplode(_lines(F.col("t"))).alias("place", "body"))
    line = F.substring(F.unhex(F.sha2("body", 256)), 1, 16).alias("line")
    return each.where(F.col("body").rlike(r"[^\x20\x09-\x0D]")).select("id", "version", "site", "size", "place", F.length("body").alias("chars"), line)


def _spread(lines: DataFrame, min_sites: int) -> DataFrame:
    # lines on fewer rows than sites are asked for cannot reach the threshold and need no sketch
    often = lines.groupBy("line").agg(F.count("*").alias("n"), F.min("id").alias("keeper")).where(F.col("n") >= min_sites)
    often, _ = materialize(often.select("line", "keeper"), "often")
    asked = lines.join(often.select("line"), "line", "left_semi")
    sketched, _ = materialize(
        asked.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(REGISTERS))).alias("sites")), "sketched"
    )
    low, high = min_sites * (1 - WIDTH * ERROR) - 1, min_sites * (1 + WIDTH * ERROR) + 1
    sure = sketched.where(F.col("sites") > high)
    near = sketched.where(F.col("sites").between(low, high)).select("line")
    exact = asked.join(near, "line", "left_semi").groupBy("line", "site").agg(F.lit(1).alias("one")).groupBy("line").agg(F.count("*").alias("sites"))
    return sure.unionByName(exact.where(F.col("sites") >= min_sites)).join(often, "line").select("line", "sites", "keeper")


def _shingles(text: Column) -> Column:
    words = F.filter(F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return _let(words, lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - SHINGLE + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, SHINGLE), " "))))


def _proven_copies(per: DataFrame, df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """__id and __version of copies. per: document, keeper and the lines x that the document shares with it. Only texts of
    pairs that share enough lines move, and pairs are compared one by one."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, s: a + s["chars"])
    once = F.array_distinct(F.transform("x", lambda s: F.struct(s["line"], s["chars"])))
    near = per.where(COPY_SHARE * total(F.col("x")) > F.col("size")).select("id", "version", "keeper", total(once).alias("shared"))
    # written, so Spark knows its size before it decides whether all texts have to move to meet it
    near, _ = materialize(near, "near")
    own_id = lambda rows: F.col("t_id").eqNullSafe(rows["id"]) & (F.col("t_version") == rows["version"])
    texts = df.select(F.col(id_col).alias("t_id"), F.xxhash64(text_col).alias("t_version"), F.col(text_col).cast("string").alias("t"))
    own, _ = materialize(texts.join(near, own_id(near), "left_semi").distinct(), "own")
    kept, _ = materialize(df.select(F.col(id_col).alias("keeper"), F.col(text_col).cast("string").alias("of")).join(near, "keeper", "left_semi").distinct(), "kept")
    asked = near.join(kept, "keeper").where(COPY_SHARE * F.col("shared") > F.length("of"))
    pairs = asked.join(own, own_id(asked))
    both = pairs.select("id", "version", _shingles(F.col("t")).alias("a"), _shingles(F.col("of")).alias("b")).withColumn("n", F.size(F.array_intersect("a", "b")))
    alike = F.col("n") * UNDER >= OVER * (F.size("a") + F.size("b") - F.col("n"))
    return both.where(alike).select(F.col("id").alias("__id"), F.col("version").alias("__version")).distinct()


def remove_spread_lines(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", site_col: str = "source", min_sites: int = MIN_SITES, keep: tuple[str, ...] = ()
) -> DataFrame:
    """The id, text without boilerplate lines, n_lines (with a word), n_removed and kept columns."""
    places = _occurrences(df, text_col, id_col, site_col)
    boilerplate, _ = materialize(_spread(places.select("line", "id", "site"), min_sites), "boilerplate")
    cut = places.join(boilerplate.select("line", "keeper"), "line").where(~F.col("id").eqNullSafe(F.col("keeper")))
    per = cut.groupBy("id", "version", "keeper").agg(F.first("size").alias("size"), F.collect_set(F.struct("line", "chars", "place")).alias("x"))
    per, _ = materialize(per, "cuts")
    cuts = per.groupBy(F.col("id").alias("__id"), F.col("version").alias("__version")).agg(F.flatten(F.collect_list(F.col("x.place"))).alias("__cut"))
    copies = _proven_copies(per, df, text_col, id_col)
    same = lambda a, b: a["__id"].eqNullSafe(b["__id"]) & (a["__version"] == b["__version"])
    cuts = cuts.join(copies, same(cuts, copies), "left_anti")
    held = df.select(F.col(id_col).alias("__own"), F.col(text_col).cast("string").alias("__text"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)])
    joined = held.join(cuts, F.col("__own").eqNullSafe(F.col("__id")) & (F.xxhash64("__text") == F.col("__version")), "left")
    lines = _lines(F.col("__text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__cut"))
    left = _let(lines, lambda each: F.array_join(F.transform(stay, lambda i: F.get(each, i)), "\n"))
    return joined.select(
        F.col("__own").alias(id_col),
        F.when(F.col("__cut").isNull(), F.col("__text")).otherwise(left).alias(text_col),
        F.size(F.filter(_lines(F.coalesce("__text", F.lit(""))), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("__cut"), F.lit(0)).cast("long").alias("n_removed"),
        *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)],
    )


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shingles_sql(text: str) -> str:
    words = f"list_filter(string_split_regex(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    return f"list_transform([{words}], lambda w: list_distinct(list_transform(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))))[1]"


SPREAD_SQL = f"""
WITH l AS (
  SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) AS place, unnest(string_split(text, chr(10))) AS body FROM documents
), w AS (
  SELECT * FROM l WHERE regexp_matches(body, '[^\\x20\\x09-\\x0D]')
), b AS (
  SELECT body, min(doc_id) AS keeper FROM w GROUP BY body HAVING count(DISTINCT coalesce(source, '')) >= {MIN_SITES}
), c AS (
  SELECT w.doc_id, b.keeper, w.body, list(w.place) AS places FROM w JOIN b USING (body) WHERE w.doc_id <> b.keeper GROUP BY ALL
), s AS (
  SELECT doc_id, keeper, sum(length(body) * length(places)) AS own, sum(length(body)) AS shared FROM c GROUP BY ALL
), x AS (
  SELECT s.doc_id, {_shingles_sql('d.text')} AS a, {_shingles_sql('o.text')} AS b
  FROM s JOIN documents d ON d.doc_id = s.doc_id JOIN documents o ON o.doc_id = s.keeper
  WHERE {COPY_SHARE} * own > length(d.text) AND {COPY_SHARE} * shared > length(o.text)
), k AS (
  SELECT DISTINCT doc_id FROM (SELECT doc_id, len(a) + len(b) AS sizes, len(list_intersect(a, b)) AS n FROM x) WHERE {UNDER} * n >= {OVER} * (sizes - n)
), p AS (
  SELECT doc_id, flatten(list(places)) AS cut FROM c WHERE doc_id NOT IN (SELECT doc_id FROM k) GROUP BY doc_id
), t AS (
  SELECT d.doc_id, d.text, cut,
         CASE WHEN cut IS NULL THEN d.text ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(cut, i)), chr(10)) END AS rest
  FROM documents d LEFT JOIN p USING (doc_id)
)
SELECT doc_id,
       CAST(length(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) AS BIGINT) AS n_lines,
       CAST(coalesce(length(cut), 0) AS BIGINT) AS n_removed,
       CAST(length(rest) AS BIGINT) AS n_kept_chars,
       sha256(rest) AS kept_sha256
FROM t
"""
