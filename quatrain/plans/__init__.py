"""Registered queries over the shared tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quatrain.functions import text as X
from quatrain.operators import annotate, forms, lexicon, prompts, sampling, scoring, segment
from quatrain.streaming import session_counts, window_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Blanks and line ends as in functions.text, written out for engines whose \\s is ASCII.
B = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LB = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
RAW = f"list_filter(list_transform(string_split_regex(text, '{LB}'), lambda x: regexp_replace(x, '^{B}+|{B}+$', '', 'g')), lambda x: x <> '')"
SIGNS = "".join("\\" + s if s in "\\[]^-&" else "''" if s == "'" else s for s in X.LINE_SIGNS)
CLEAN = f"[{SIGNS}{B[1:-1]}]+"
CLEANED = f"list_transform({RAW}, lambda x: regexp_replace(x, '{CLEAN}', '', 'g'))"

VERSES = (forms.Form("quatrain", 4, r"^.+\z"), forms.Form("octave", 8, r"^.+\z"))
FORM_SQL = "CASE len(lines) WHEN 4 THEN 'quatrain' WHEN 8 THEN 'octave' END"
WORDS = {"water": ("thea", "ea", "sea"), "light": ("st", "hent", "est"), "time": ("then", "hent", "erst", "en"), "place": ("thin", "in", "ing")}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").withColumn("lines", X.raw_lines(F.col("text")))
    return forms.keep_first(forms.with_form(docs, forms=VERSES), ["text"], ["doc_id"])


CANDIDATES_SQL = f"""
cand AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM (
      SELECT doc_id, text, lang, source, lines, {FORM_SQL} AS form
      FROM (SELECT doc_id, text, lang, source, {RAW} AS lines FROM documents)
    ) WHERE form IS NOT NULL
  ) WHERE rn = 1
)"""


@query(f"WITH {CANDIDATES_SQL} SELECT form, count(*) AS n_candidates, count(DISTINCT source) AS n_authors FROM cand GROUP BY form")
def form_counts(spark, sf_dir):
    """Deduplicated structural candidates by form, and their authors."""
    return _candidates(spark, sf_dir).groupBy("form").agg(F.count("*").alias("n_candidates"), F.count_distinct("source").alias("n_authors"))


@query("SELECT doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def keep_first_dedup(spark, sf_dir):
    return forms.keep_first(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), ["text"], ["doc_id"]).select("doc_id", "n_chars")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'tang-' || doc_id ELSE 'tang-sha1-' || substr(sha1(text), 1, 16) END AS id FROM documents")
def stable_ids(spark, sf_dir):
    source = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", X.stable_id(source, F.col("text")).alias("id"))


@query(f"WITH {CANDIDATES_SQL} SELECT form, count(*) AS n_rows, count(DISTINCT source) AS n_entities FROM cand GROUP BY ROLLUP (form)")
def form_report(spark, sf_dir):
    return annotate.form_report(_candidates(spark, sf_dir), "form", "source")


@query(
    f"WITH {CANDIDATES_SQL}, per AS (SELECT source, count(*) AS n, count(DISTINCT form) AS f FROM cand GROUP BY source) "
    "SELECT count(*) AS n_entities, count(*) FILTER (f > 1) AS n_in_several, coalesce(max(n), 0) AS most_rows FROM per"
)
def author_coverage(spark, sf_dir):
    return annotate.diversity(_candidates(spark, sf_dir), "form", "source")


@query(
    "SELECT lang, CAST(sum(n) AS BIGINT) AS rows, count(*) AS entities, CAST(sum(least(n, 2)) AS BIGINT) AS capacity "
    "FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source) GROUP BY lang"
)
def sampling_capacity(spark, sf_dir):
    return sampling.capacity(table(spark, sf_dir, "documents"), "lang", "source", 2)


SAMPLE = {"en": 15, "fr": 10, "de": 10, "es": 8}


@query("""
WITH a AS (
  SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5('7|' || doc_id), doc_id) AS r
  FROM documents
), b AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY r, md5('7|' || source), source) AS t FROM a WHERE r <= 2
), c AS (SELECT * FROM b WHERE t <= CASE lang WHEN 'en' THEN 15 WHEN 'es' THEN 8 ELSE 10 END)
SELECT doc_id, lang, source, CAST(row_number() OVER (ORDER BY md5('1004|' || doc_id), doc_id) AS INTEGER) AS annotation_pos FROM c
""")
def balanced_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return sampling.balanced_sample(docs, "lang", "source", "doc_id", SAMPLE, 7, 2)


@query(f"""
SELECT doc_id, len(l) = 4 AND len(list_filter(l, lambda x: length(x) <> 60)) = 0 AS ok,
       round_even(CASE WHEN len(l) = 4 THEN list_sum(list_transform(l, lambda x: greatest(0.0, 1.0 - abs(length(x) - 60) / 60.0::DOUBLE))) / 4 ELSE 0.0 END, 6) AS score,
       len(l) AS n_lines
FROM (SELECT doc_id, {CLEANED} AS l FROM documents)
""")
def form_meter_score(spark, sf_dir):
    scored = table(spark, sf_dir, "documents").select("doc_id", scoring.check_form(F.col("text"), 4, 60).alias("s"))
    return scored.select("doc_id", "s.ok", F.bround("s.score", 6).alias("score"), F.size("s.lines_clean").cast("long").alias("n_lines"))


PAIR_SQL = """CASE WHEN {a} IS NULL OR {b} IS NULL OR {a} = '' OR {b} = '' OR length({a}) <> length({b}) THEN 0.0
  ELSE len(list_filter(list_zip(string_split({a}, ''), string_split({b}, '')), lambda p: p[1] <> p[2])) / length({a})::DOUBLE END"""


@query(f"SELECT doc_id, s >= 0.6 AS ok, round_even(s, 6) AS score FROM (SELECT doc_id, {PAIR_SQL.format(a='l[1]', b='l[2]')} AS s FROM (SELECT doc_id, {CLEANED} AS l FROM documents))")
def line_pair_diff(spark, sf_dir):
    """The first line against the second; lines of unequal length are no pair."""
    lines = table(spark, sf_dir, "documents").select("doc_id", X.clean_lines(F.col("text")).alias("l"))
    first, second = F.get("l", F.lit(0)), F.get("l", F.lit(1))
    return lines.select("doc_id", scoring.check_pair(first, second).alias("s")).select("doc_id", "s.ok", F.bround("s.score", 6).alias("score"))


@query(f"""
SELECT doc_id, len(l) >= 4 AND a >= 0.01 AND b >= 0.01 AS ok, round_even(CASE WHEN len(l) >= 4 THEN (a + b) / 2 ELSE 0.0 END, 6) AS score
FROM (SELECT doc_id, l, {PAIR_SQL.format(a='l[1]', b='l[2]')} AS a, {PAIR_SQL.format(a='l[3]', b='l[4]')} AS b FROM (SELECT doc_id, {CLEANED} AS l FROM documents))
""")
def parallel_score(spark, sf_dir):
    scored = table(spark, sf_dir, "documents").select("doc_id", scoring.check_parallel(F.col("text"), ((1, 2), (3, 4)), threshold=0.01).alias("s"))
    return scored.select("doc_id", "s.ok", F.bround("s.score", 6).alias("score"))


@query(f"""
SELECT doc_id, len(l) >= 4 AND coalesce(len(list_filter(f, lambda x: x IS NULL)), 4) = 0 AND f[1] = f[2] AND f[1] = f[3] AND f[1] = f[4] AS ok,
       CASE WHEN len(l) < 4 OR len(list_filter(f, lambda x: x IS NULL)) > 0 THEN 0.0 ELSE len(list_filter(f, lambda x: x = f[1])) / 4.0::DOUBLE END AS score
FROM (SELECT doc_id, l, list_transform([l[1], l[2], l[3], l[4]], lambda x: lower(nullif(right(x, 1), ''))) AS f FROM (SELECT doc_id, {CLEANED} AS l FROM documents))
""")
def rhyme_at_positions(spark, sf_dir):
    scored = table(spark, sf_dir, "documents").select("doc_id", scoring.check_rhymes(F.col("text"), scoring.LastSign(), (1, 2, 3, 4)).alias("s"))
    return scored.select("doc_id", "s.ok", "s.score")


@query(f"""
SELECT doc_id, coalesce(m = 1.0 AND r = 1.0, false) AS ok, round_even(0.7 * m + 0.3 * r, 6) AS total FROM (
  SELECT doc_id,
    CASE WHEN len(l) = 4 THEN list_sum(list_transform(l, lambda x: greatest(0.0, 1.0 - abs(length(x) - 60) / 60.0::DOUBLE))) / 4 ELSE 0.0 END AS m,
    CASE WHEN len(l) >= 4 AND length(l[2]) > 0 AND length(l[4]) > 0 AND lower(right(l[2], 1)) = lower(right(l[4], 1)) THEN 1.0 ELSE 0.0 END::DOUBLE AS r
  FROM (SELECT doc_id, {CLEANED} AS l FROM documents))
""")
def composite_score(spark, sf_dir):
    scored = table(spark, sf_dir, "documents").select("doc_id", scoring.score_quatrain(F.col("text"), scoring.LastSign(), n_chars=60).alias("s"))
    return scored.select("doc_id", "s.ok", F.bround("s.total", 6).alias("total"))


def _lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, i, t) for i, (c, ts) in enumerate(WORDS.items()) for t in ts], "category string, cat_pos int, term string")


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.find_matches(table(spark, sf_dir, "documents"), _lexicon(spark), "doc_id")


LEXICON_SQL = "lex(category, cat_pos, term) AS (VALUES " + ", ".join(f"('{c}', {i}, '{t}')" for i, (c, ts) in enumerate(WORDS.items()) for t in ts) + ")"
ALL_TERMS = ", ".join(sorted({f"'{t}'" for ts in WORDS.values() for t in ts}))
MATCHES_SQL = f"""{LEXICON_SQL}, chars AS (
  SELECT doc_id, string_split(replace(text, chr(10), ''), '') AS c FROM documents WHERE length(replace(text, chr(10), '')) > 0
), spans AS (
  SELECT doc_id, n, unnest(list_filter(list_transform(range(1, len(c) - n + 2), lambda i: {{'i': i, 't': c[i] || c[i + 1] || CASE WHEN n > 2 THEN c[i + 2] ELSE '' END || CASE WHEN n > 3 THEN c[i + 3] ELSE '' END}}),
    lambda x: x.t IN ({ALL_TERMS}))) AS x
  FROM chars, (VALUES (2), (3), (4)) AS k(n)
), grams AS (
  SELECT doc_id, x.i - 1 AS start, n, x.t AS term FROM spans
), hits AS (
  SELECT doc_id, category, cat_pos, term, start, start + n AS "end" FROM grams JOIN lex USING (term)
), m AS (
  SELECT doc_id, category, cat_pos, term, start, "end" FROM (
    SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
           max("end") OVER (PARTITION BY doc_id, start) AS w FROM hits)
  WHERE coalesce(b, -1) < "end" AND w = "end"
), terms AS (
  SELECT doc_id, category, cat_pos, list(term ORDER BY s) AS terms
  FROM (SELECT doc_id, category, cat_pos, term, min(start) AS s FROM m GROUP BY ALL) GROUP BY doc_id, category, cat_pos
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len(terms) DESC, cat_pos) AS rank FROM terms
)"""


@query(f"WITH {MATCHES_SQL} SELECT doc_id, category, term, count(*) AS n, CAST(min(start) AS INTEGER) AS first_start FROM m GROUP BY doc_id, category, term")
def lexicon_matches(spark, sf_dir):
    return _matches(spark, sf_dir).groupBy("doc_id", "category", "term").agg(F.count("*").alias("n"), F.min("start").alias("first_start"))


@query(f"WITH {MATCHES_SQL} SELECT doc_id, category, CAST(rank AS INTEGER) AS rank, len(terms) AS n_terms FROM ranked WHERE rank <= 4")
def imagery_top4(spark, sf_dir):
    top = lexicon.top_categories(lexicon.category_terms(_matches(spark, sf_dir), "doc_id"), "doc_id")
    return top.select("doc_id", "category", "rank", F.size("terms").cast("long").alias("n_terms"))


@query(f"""
WITH {MATCHES_SQL}, g AS (
  SELECT doc_id, list(category ORDER BY rank) AS v, sum(len(terms)) AS n, count(*) AS c FROM ranked WHERE rank <= 4 GROUP BY doc_id
)
SELECT doc_id, coalesce(array_to_string(v, ','), '') AS labels,
       CASE WHEN c > 0 THEN round_even(least(0.92, 0.42::DOUBLE + 0.07::DOUBLE * n + 0.04::DOUBLE * c), 3) ELSE 0.2 END AS confidence
FROM documents LEFT JOIN g USING (doc_id)
""")
def imagery_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    found = lexicon.imagery_prelabel(docs, lexicon.category_terms(_matches(spark, sf_dir), "doc_id"), "doc_id")
    return found.select("doc_id", F.array_join("imagery.value", ",").alias("labels"), "imagery.confidence")


DENSITY_SQL = f"""{MATCHES_SQL}, dens AS (
  SELECT doc_id, coalesce(n, 0) / greatest(1, k)::DOUBLE AS s FROM (SELECT doc_id, len({RAW}) AS k FROM documents)
  LEFT JOIN (SELECT doc_id, count(DISTINCT term) AS n FROM m GROUP BY doc_id) USING (doc_id)
), labelled AS (SELECT doc_id, s, CASE WHEN s < 0.75 THEN 'sparse' WHEN s < 1.5 THEN 'medium' ELSE 'dense' END AS value FROM dens)"""


def _density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.density_prelabel(table(spark, sf_dir, "documents"), lexicon.category_terms(_matches(spark, sf_dir), "doc_id"), "doc_id")


@query(f"""
WITH {DENSITY_SQL}
SELECT doc_id, value, round_even(0.50::DOUBLE + 0.35::DOUBLE * least(greatest(CASE WHEN s < 0.75 THEN (0.75::DOUBLE - s) / 0.75::DOUBLE
  WHEN s < 1.5 THEN least(s - 0.75::DOUBLE, 1.5::DOUBLE - s) / 0.375::DOUBLE ELSE (s - 1.5::DOUBLE) / 1.5::DOUBLE END, 0.0), 1.0), 3) AS confidence, round_even(s, 3) AS per_line
FROM labelled
""")
def density_label(spark, sf_dir):
    found = _density(spark, sf_dir)
    return found.select("doc_id", "density.value", "density.confidence", F.col("density.evidence.unique_imagery_terms_per_line").alias("per_line"))


@query(f"WITH {MATCHES_SQL} SELECT category AS label, count(*) AS n FROM ranked WHERE rank <= 4 GROUP BY category")
def label_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    found = lexicon.imagery_prelabel(docs, lexicon.category_terms(_matches(spark, sf_dir), "doc_id"), "doc_id")
    return annotate.label_counts(found, "imagery.value")


@query(f"""
WITH {DENSITY_SQL}
SELECT count(*) AS n_rows, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM m)) AS imagery_empty, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS llm_complete,
       count(*) FILTER (value = 'sparse') AS density_sparse, count(*) FILTER (value = 'medium') AS density_medium, count(*) FILTER (value = 'dense') AS density_dense
FROM labelled
""")
def annotation_report(spark, sf_dir):
    docs, terms = table(spark, sf_dir, "documents"), lexicon.category_terms(_matches(spark, sf_dir), "doc_id")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit(True).alias("done"))
    rows = lexicon.imagery_prelabel(docs, terms, "doc_id").join(lexicon.density_prelabel(docs, terms, "doc_id"), "doc_id").join(good, "doc_id", "left")
    flat = rows.select(F.col("imagery.value").alias("imagery"), F.col("density.value").alias("density"), "done")
    return annotate.annotation_report(flat, "imagery", "density", F.coalesce("done", F.lit(False)))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (json_valid(props) AND json_type(props) = 'OBJECT') AS n_objects FROM events GROUP BY event_type")
def json_objects(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(X.json_object_in(F.col("props")).isNotNull()).alias("n_objects"))



@query("""
SELECT doc_id, CASE WHEN l.quality = 1 THEN 'joy' END AS emotion, CASE WHEN l.quality = 1 THEN 'plain' END AS diction, coalesce(l.quality = 1, false) AS complete
FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def resume_merge(spark, sf_dir):
    """Labels of an earlier run survive where they are finished; the rest is pending again."""
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("quality") == 1, "prelabeled").otherwise("pending_llm")
    old = F.struct(*[annotate.pending(d).withField("status", status).withField("value", F.array(F.lit("joy")) if d == "emotion" else F.lit("plain")).alias(d) for d in annotate.MODEL_DIMS])
    fresh = F.struct(*[annotate.pending(d).alias(d) for d in annotate.MODEL_DIMS])
    merged = joined.select("doc_id", annotate.resume(fresh, old).alias("p"))
    return merged.select("doc_id", F.get("p.emotion.value", F.lit(0)).alias("emotion"), F.col("p.diction.value").alias("diction"), annotate.is_complete(F.col("p")).alias("complete"))


@query("SELECT doc_id FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE quality = 1) USING (doc_id) ORDER BY doc_id LIMIT 10")
def pending_limit(spark, sf_dir):
    done = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit(True).alias("done"))
    joined = table(spark, sf_dir, "documents").select("doc_id").join(done, "doc_id", "left")
    return annotate.pending_rows(joined, F.coalesce("done", F.lit(False)), "doc_id").select("doc_id")


@query(f"""
WITH l AS (
  SELECT doc_id, generate_subscripts(lines, 1) - 1 AS pos, unnest(lines) AS line FROM (SELECT doc_id, {RAW} AS lines FROM documents)
), a AS (
  SELECT *, line[1] BETWEEN 'A' AND 'M' AS begins, CASE WHEN line[1] = 'T' THEN 'body' WHEN line[1] = 'O' THEN 'note' END AS own,
         CASE WHEN line[1] IN ('T', 'O') THEN line[2:] WHEN line[1] BETWEEN 'A' AND 'M' THEN '' ELSE line END AS rest,
         lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS ahead FROM l
), b AS (
  SELECT *, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS entry FROM a
), c AS (
  SELECT *, last_value(own IGNORE NULLS) OVER w AS field, first_value(line) OVER w AS title, first_value(ahead) OVER w AS before
  FROM b WHERE entry > 0 WINDOW w AS (PARTITION BY doc_id, entry ORDER BY pos ROWS UNBOUNDED PRECEDING)
)
SELECT doc_id, CAST(entry AS BIGINT) AS entry, field, md5(string_agg(rest, chr(10) ORDER BY pos)) AS text_md5, md5(title) AS title_md5, before IS NULL AS leads
FROM c WHERE field IS NOT NULL AND rest <> '' GROUP BY doc_id, entry, field, title, before
""")
def segment_entries(spark, sf_dir):
    lines = segment.number_paragraphs(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = segment.sessionize(lines, "doc_id", F.substring("line", 1, 1).between("A", "M"), [("body", "T"), ("note", "O")])
    return found.select("doc_id", "entry", "field", F.md5("text").alias("text_md5"), F.md5("title").alias("title_md5"), F.col("before").isNull().alias("leads"))


def _case(mapping: dict, key: str, default: str | None) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN {k if isinstance(k, int) else repr(k)} THEN '" + v.replace("'", "''") + "'" for k, v in mapping.items()) + (f" ELSE '{default}'" if default else "") + " END"


@query(f"""
SELECT conv_id, turn, concat_ws(chr(10),
  'Rewrite this ' || {_case(prompts.LANGUAGES, 's', prompts.DEFAULT_LANGUAGE)} || ' poem as a ' || {_case(prompts.LANGUAGES, 't', prompts.DEFAULT_LANGUAGE)} || ' poem (' || {_case(prompts.STYLES, 'style', prompts.DEFAULT_STYLE)} || ').',
  'Form: ' || coalesce({_case(prompts.FORMS, 'style', None)}, {_case(prompts.MODERN, 't', 'free Chinese verse')}),
  'Freedom: ' || coalesce({_case(prompts.INTENSITY, 'i', None)}, '{prompts.INTENSITY[3]}'),
  'Answer with the parts 【转写结果】 and 【转写思路】.', text) AS prompt
FROM (SELECT *, CASE turn % 3 WHEN 0 THEN 'ZH' WHEN 1 THEN 'KO' ELSE 'RU' END AS s, CASE WHEN turn % 3 = 1 THEN 'ZH' ELSE 'KO' END AS t,
             CASE role WHEN 'user' THEN 'sijo' WHEN 'assistant' THEN 'modern' END AS style, conv_id % 7 AS i FROM conversations)
WHERE trim(text) <> ''
""")
def prompt_render(spark, sf_dir):
    talks = table(spark, sf_dir, "conversations")
    source = F.when(F.col("turn") % 3 == 0, "ZH").when(F.col("turn") % 3 == 1, "KO").otherwise("RU")
    requests = talks.select(
        "conv_id", "turn", "text", F.when(F.col("role") == "user", "sijo").when(F.col("role") == "assistant", "modern").alias("style"), source.alias("source_lang"),
        prompts.target_language(source, F.lit("KO")).alias("target_lang"), (F.col("conv_id") % 7).alias("intensity"),
    )
    return prompts.render_requests(requests).select("conv_id", "turn", "prompt")


@query("SELECT conv_id, turn, CASE WHEN instr(text, 'the') > 0 THEN trim(regexp_extract(text, '(?s)the\\s*(.*?)(?:and|$)', 1), ' ' || chr(9) || chr(10)) ELSE text END AS part FROM conversations")
def response_split(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.section_between(F.col("text"), "the", "and").alias("part"))


@query("""
SELECT d.doc_id, d.lang IS DISTINCT FROM 'en' AS no_original, l.quality IS NULL AS no_translation
FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.lang IS DISTINCT FROM 'en' OR l.quality IS NULL
""")
def incomplete_pairs(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("zh")), "doc_id", "left")
    return segment.incomplete_pairs(joined.withColumn("ko", F.when(F.col("lang") == "en", "en")), "doc_id", ["ko"], "zh")



@query(f"SELECT doc_id, len(l) AS n_pieces, md5(array_to_string(l, '|')) AS pieces_md5 FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[，。！？；：,.!?;:\n\r]+'), lambda x: regexp_replace(x, '{B}+', '', 'g')), lambda x: x <> '') AS l FROM documents)")
def verse_split(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", X.verse_lines(F.array("text")).alias("l"))
    return lines.select("doc_id", F.size("l").cast("long").alias("n_pieces"), F.md5(F.array_join("l", "|")).alias("pieces_md5"))



@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return window_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 3))


@query("""
WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM a)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM b GROUP BY user_id, k
""")
def event_sessions(spark, sf_dir):
    return session_counts(table(spark, sf_dir, "events"))


@query("SELECT text_md5, n FROM (SELECT md5(text) AS text_md5, count(*) AS n FROM documents GROUP BY text) WHERE n > 1")
def duplicate_texts(spark, sf_dir):
    return sampling.duplicate_ids(table(spark, sf_dir, "documents").select(F.md5("text").alias("text_md5")), "text_md5")


from quatrain.plans import runs, wide  # noqa: E402, F401  (register further queries)
