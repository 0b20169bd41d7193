"""Lexicon matches with longest-span suppression, and the weak labels that follow from them.

A lexicon is a DataFrame (category, cat_pos, term) of any size. Its terms are hashed by their lengths, BLOCK_SIGNS signs at
most together, and broadcast with their categories: the bound holds whatever the lexicon's size, as a larger lexicon makes
more blocks. Texts are searched once a block, in time that grows with their length and with the number of lengths of terms;
what a match of another block covers is dropped in the same task, which holds one block and the matches of GROUP_SIGNS signs.
Lexicons of more than LENGTHS lengths become automata instead, whose time grows with the text alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quatrain.functions import text as X
from quatrain.functions.automaton import Automaton
from quatrain.functions.windows import Windows, signs_of

#: Signs of the terms that share a block; so many take some 300 MB in a worker.
BLOCK_SIGNS = 32_000_000
#: Signs of the terms that share an automaton; one of so many states takes some 200 MB in a worker.
AUTOMATON_SIGNS = 1_000_000
#: Different lengths of terms up to which windows are faster than automata.
LENGTHS = 64
#: Signs of texts that are searched together.
PART_SIGNS = 1 << 20
#: Signs of texts whose matches are held while block after block is loaded; so many take some 300 MB in a worker.
GROUP_SIGNS = 1 << 23


def find_matches(docs: DataFrame, lexicon: DataFrame, id_col: str = "id", text_col: str = "text", block_signs: int = BLOCK_SIGNS) -> DataFrame:
    """(id, category, cat_pos, term, start, end) of every occurrence, overlaps included, that no longer match covers.
    Line breaks are removed first, so terms may run over line ends. Equal spans of two categories both stay. Rows that
    repeat an id are matched each for itself."""
    return _matched(docs, _blocks(lexicon, block_signs), _named(lexicon), id_col, text_col)


def count_matches(docs: DataFrame, lexicon: DataFrame, id_col: str = "id", text_col: str = "text", block_signs: int = BLOCK_SIGNS) -> DataFrame:
    """(id, category, cat_pos, n, n_terms, first_start): how many matches and distinct terms, and the first start, where there
    are any. They are counted where a text is read, so that no match leaves its task. Only rows that repeat an id share
    terms with others: their matches alone are shuffled."""
    kinds, of = _named(lexicon)[:2], (id_col, "category", "cat_pos")
    blocks = _blocks(lexicon, block_signs)
    again = docs.groupBy(F.col(id_col).alias("__again")).agg(F.count("*").alias("__n")).where("__n > 1").select("__again")
    repeated = not again.isEmpty()
    same = F.col(id_col).eqNullSafe(F.col("__again"))
    once = docs.join(again, same, "left_anti") if repeated else docs
    figures = [T.StructField("n", T.LongType()), T.StructField("n_terms", T.LongType()), T.StructField("first_start", T.IntegerType())]
    found = _scanned(once, id_col, text_col, blocks, [*kinds, *figures], Entries.counts)
    if len(blocks) > 1:
        # no term is in two blocks
        found = found.groupBy(*of).agg(F.sum("n").alias("n"), F.sum("n_terms").alias("n_terms"), F.min("first_start").alias("first_start"))
    if repeated:
        more = _matched(docs.join(again, same, "left_semi"), blocks, _named(lexicon), id_col, text_col)
        found = found.union(more.groupBy(*of).agg(F.count("*").alias("n"), F.count_distinct("term").alias("n_terms"), F.min("start").alias("first_start")))
    return found


def _named(lexicon: DataFrame) -> list[T.StructField]:
    return [T.StructField(c, lexicon.schema[c].dataType) for c in ("category", "cat_pos", "term")]


def _blocks(lexicon: DataFrame, block_signs: int) -> list[Broadcast]:
    """The lexicon's terms, each in one block, as Entries."""
    terms = lexicon.where("term <> ''").select("category", "cat_pos", "term").distinct()
    of = terms.select("term").distinct().agg(F.sum(F.length("term")).alias("signs"), F.count_distinct(F.length("term")).alias("lengths")).first()
    by_length = of["lengths"] <= LENGTHS
    n_blocks = max(1, -(-(of["signs"] or 0) // (block_signs if by_length else min(block_signs, AUTOMATON_SIGNS))))
    blocks = []
    for block in range(n_blocks):
        own = terms if n_blocks == 1 else terms.where(F.pmod(F.xxhash64("term"), F.lit(n_blocks)) == block)
        # a block's terms are as many as its signs allow
        blocks.append(lexicon.sparkSession.sparkContext.broadcast(Entries(own.toArrow(), by_length)))
    return blocks


def _matched(docs: DataFrame, blocks: list[Broadcast], named: list[T.StructField], id_col: str, text_col: str) -> DataFrame:
    places = [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
    return _scanned(docs, id_col, text_col, blocks, [*named, *places], Entries.matches)


class Entries:
    """A block of a lexicon's rows by their terms, and what finds these in texts."""

    def __init__(self, rows: pa.Table, by_length: bool):
        named = rows.combine_chunks().column("term").combine_chunks().dictionary_encode()
        number = named.indices.to_numpy(zero_copy_only=False)
        self.terms = named.dictionary
        self.order = np.argsort(number, kind="stable")
        self.rows = rows.select(["category", "cat_pos"]).combine_chunks()
        self.first = np.searchsorted(number[self.order], np.arange(len(self.terms) + 1))
        codes = [_one(self.rows.column(c)).dictionary_encode(null_encoding="encode") for c in ("category", "cat_pos")]
        code, pos = (c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in codes)
        # rows of one category, by number, and a row of each
        _, self.example, kind = np.unique(code * max(1, len(codes[1].dictionary)) + pos, return_index=True, return_inverse=True)
        self.kind = kind.astype(np.int32)
        self.windows = Windows(self.terms) if by_length else None
        self.automaton = None if by_length else Automaton(self.terms.to_pylist())
        self._numbers = None

    def spans(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, size, number) of the uncovered occurrences in the texts."""
        if self.windows is not None:
            signs, begins = signs_of(texts)
            start, size, number = self.windows.uncovered(signs)
            text = np.searchsorted(begins, start, "right") - 1
            return text, start - begins[text], size, number
        if self._numbers is None:
            self._numbers = {t: i for i, t in enumerate(self.terms.to_pylist())}
        found = [(i, a, b - a, self._numbers[t[a:b]]) for i, t in enumerate(texts) for a, b in self.automaton.uncovered(t)]
        return tuple(np.array(found, np.int64).reshape(-1, 4).T)

    def _held(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A match and a row of the lexicon for each category of each match."""
        times = self.first[number + 1] - self.first[number]
        hit = np.repeat(np.arange(len(number)), times)
        return hit, self.order[self.first[number][hit] + np.arange(len(hit)) - np.repeat(np.cumsum(times) - times, times)]

    def _categories(self, entry: np.ndarray) -> list[pa.Array]:
        return [_one(self.rows.column(c)).take(pa.array(entry)) for c in ("category", "cat_pos")]

    def matches(self, text: np.ndarray, start: np.ndarray, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
        """Each match's text, and its category, cat_pos, term, start and end."""
        hit, entry = self._held(number)
        places = [pa.array(x[hit], pa.int32()) for x in (start, start + size)]
        return text[hit], [*self._categories(entry), self.terms.take(pa.array(number[hit])), *places]

    def counts(self, text: np.ndarray, start: np.ndarray, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
        """Each text and category with matches: the text, and the category, cat_pos, matches, distinct terms and first start."""
        hit, entry = self._held(number)
        every = pa.table({"text": text[hit], "kind": self.kind[entry], "number": number[hit], "start": start[hit].astype(np.int32)})
        of = every.group_by(["text", "kind"], use_threads=False).aggregate([("start", "count"), ("number", "count_distinct"), ("start", "min")]).combine_chunks()
        figures = [_one(of.column(c)) for c in ("start_count", "number_count_distinct", "start_min")]
        return of.column("text").to_numpy(), [*self._categories(self.example[of.column("kind").to_numpy()]), *figures]


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()


def parts_of(sizes: np.ndarray, most: int = PART_SIGNS) -> Iterator[tuple[int, int]]:
    """Runs of rows with so many signs together, or one row."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, upto
        at = upto


def _scanned(docs: DataFrame, id_col: str, text_col: str, blocks: list[Broadcast], fields: list[T.StructField], form: Callable) -> DataFrame:
    """The id, and what form makes of the entries of each block and of its uncovered matches."""
    source = docs.select(id_col, F.replace(text_col, F.lit("\n"), F.lit("")).alias("__t")).where("__t is not null")
    schema = T.StructType([source.schema.fields[0], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at, upto in parts_of(_sizes(texts), PART_SIGNS if len(blocks) == 1 else GROUP_SIGNS):
                for row, columns in _formed(blocks, texts[at:upto], form):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + at)), *columns], names=schema.names)

    return source.mapInArrow(run, schema)


def _sizes(texts: list[str]) -> np.ndarray:
    return np.fromiter(map(len, texts), np.int64, len(texts))


def _formed(blocks: list[Broadcast], texts: list[str], form: Callable) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
    if len(blocks) == 1:
        entries = blocks[0].value
        yield form(entries, *entries.spans(texts))
        return
    parts = list(parts_of(_sizes(texts)))
    found = [_spans(block, texts, parts) for block in blocks]
    for block, spans, kept in zip(blocks, found, _uncovered(found), strict=True):
        yield from _of_block(block, [x[kept] for x in spans], parts, form)


def _of_block(block: Broadcast, spans: list[np.ndarray], parts: list[tuple[int, int]], form: Callable) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
    entries = _opened(block)
    for a, z in np.searchsorted(spans[0], np.array(parts)).tolist():
        yield form(entries, *(x[a:z] for x in spans))


def _opened(block: Broadcast) -> Entries:
    """One of several blocks, which is not kept: a worker holds one at a time."""
    return block.value if hasattr(block, "_value") else block.load_from_path(block._path)


def _spans(block: Broadcast, texts: list[str], parts: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
    entries, found = _opened(block), []
    for at, upto in parts:
        text, *rest = entries.spans(texts[at:upto])
        found.append((text + at, *rest))
    return tuple(np.concatenate(x).astype(np.int32) for x in zip(*found, strict=True))


def _uncovered(found: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """Of each block's (text, start, size, number), which no longer one of another block covers."""
    text, start, size = (np.concatenate(x) for x in list(zip(*found, strict=True))[:3])
    kept = np.zeros(len(text), bool)
    if len(text):
        ends = start.astype(np.int64) + size
        order = np.lexsort((-size, start, text))
        # ends of a later text are beyond those of an earlier one
        ends = (text * (ends.max() + 1) + ends)[order]
        kept[order] = np.append(True, ends[1:] > np.maximum.accumulate(ends)[:-1])
    return np.split(kept, np.cumsum([len(f[0]) for f in found])[:-1])


def suppress_covered(matches: DataFrame, id_col: str | list[str] = "id") -> DataFrame:
    """Drop a match if a strictly longer one covers it, by two running maxima instead of a range self-join: of matches
    that begin earlier none may end as late, and of those that begin with it none may end later."""
    ids = [id_col] if isinstance(id_col, str) else id_col
    earlier = Window.partitionBy(*ids).orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(*ids, "start")
    marked = matches.withColumn("__before", F.max("end").over(earlier)).withColumn("__with", F.max("end").over(same))
    return marked.where((F.coalesce("__before", F.lit(-1)) < F.col("end")) & (F.col("__with") == F.col("end"))).drop("__before", "__with")


def category_terms(matches: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, category, cat_pos, terms): distinct terms in order of their first occurrence, where there are any."""
    # numbers alone, so that equal terms meet in a map as they are found, and matches are never sorted
    first = matches.groupBy(id_col, "category", "cat_pos", "term").agg(F.min("start").alias("start"))
    at = F.struct("start", (-F.length("term")).alias("n"), "term")
    listed = first.groupBy(id_col, "category", "cat_pos").agg(F.sort_array(F.collect_list(at)).alias("x"))
    return listed.select(id_col, "category", "cat_pos", F.transform("x", lambda s: s["term"]).alias("terms"))


def all_categories(docs: DataFrame, terms: DataFrame, lexicon: DataFrame, id_col: str = "id") -> DataFrame:
    """category_terms with every category for every document, without hits an empty list. The lexicon's few categories are
    listed on each document, so nothing is crossed."""
    names = lexicon.select(F.struct("cat_pos", "category").alias("c")).distinct().agg(F.sort_array(F.collect_list("c")).alias("every")).first()["every"]
    every = F.array(*[F.struct(F.lit(c["cat_pos"]).alias("cat_pos"), F.lit(c["category"]).alias("category")) for c in names])
    listed = docs.select(id_col, F.explode(every).alias("c")).select(id_col, "c.category", "c.cat_pos")
    joined = listed.join(terms, [id_col, "category", "cat_pos"], "left")
    return joined.withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))


def top_categories(terms: DataFrame, id_col: str = "id", most: int = 4) -> DataFrame:
    """The categories with most distinct terms; ties by the lexicon's order. Adds rank."""
    w = Window.partitionBy(id_col).orderBy(F.size("terms").desc(), "cat_pos")
    return terms.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def imagery_prelabel(docs: DataFrame, terms: DataFrame, id_col: str = "id", most: int = 4) -> DataFrame:
    """id and imagery: value (categories by rank), confidence, evidence, method, status."""
    top = top_categories(terms, id_col, most)
    grouped = top.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("rank", "category", "terms"))).alias("x"))
    n, c = F.aggregate("x", F.lit(0), lambda a, s: a + F.size(s["terms"])), F.size("x")
    joined = docs.select(id_col).join(grouped, id_col, "left")
    sure = F.when(c > 0, F.bround(F.least(F.lit(0.92), F.lit(0.42) + 0.07 * n + 0.04 * c), 3)).otherwise(F.lit(0.20))
    none = F.array().cast("array<string>")
    return joined.select(
        id_col,
        F.struct(
            F.coalesce(F.transform("x", lambda s: s["category"]), none).alias("value"),
            F.coalesce(sure, F.lit(0.20)).alias("confidence"),
            F.coalesce(F.map_from_entries(F.transform("x", lambda s: F.struct(s["category"], s["terms"]))), F.create_map().cast("map<string,array<string>>")).alias("evidence"),
            F.lit("lexicon_longest_match_v1").alias("method"),
            F.lit("prelabeled").alias("status"),
        ).alias("imagery"),
    )


def density_confidence(score: Column, low: float, high: float) -> Column:
    """How far a score lies from the nearest threshold, on the scale of its zone."""
    far = (
        F.when(score < low, (low - score) / max(low, 0.5))
        .when(score < high, F.least(score - low, high - score) / max((high - low) / 2, 0.25))
        .otherwise((score - high) / max(high, 0.5))
    )
    return 0.50 + 0.35 * F.least(F.greatest(far, F.lit(0.0)), F.lit(1.0))


#: Fixed value: what the density label says of itself.
DENSITY_SCOPE = "weak proxy: all lexicon imagery-cue concentration only"


def density_prelabel(docs: DataFrame, terms: DataFrame, id_col: str = "id", text_col: str = "text", low: float = 0.75, high: float = 1.5, most: int = 4) -> DataFrame:
    """id and density: value, confidence and evidence (distinct terms of all categories, lines, terms a line, and the
    imagery labels that were chosen)."""
    if not 0 <= low < high:
        raise ValueError("thresholds must satisfy 0 <= low < high")
    counts = terms.select(id_col, F.explode("terms").alias("term")).groupBy(id_col).agg(F.count_distinct("term").alias("__n"))
    chosen = top_categories(terms, id_col, most).groupBy(id_col).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "category"))), lambda s: s["category"]).alias("__chosen"))
    joined = docs.select(id_col, F.size(X.raw_lines(F.col(text_col))).alias("__lines")).join(counts, id_col, "left").join(chosen, id_col, "left")
    n = F.coalesce("__n", F.lit(0)).cast("int")
    score = n / F.greatest("__lines", F.lit(1))
    value = F.when(score < low, "sparse").when(score < high, "medium").otherwise("dense")
    evidence = F.struct(
        n.alias("unique_imagery_terms"), F.col("__lines").alias("line_count"), F.bround(score, 3).alias("unique_imagery_terms_per_line"),
        F.struct(F.lit(low).alias("sparse_to_medium"), F.lit(high).alias("medium_to_dense")).alias("thresholds"),
        F.coalesce("__chosen", F.array().cast("array<string>")).alias("selected_imagery_labels"), F.lit(DENSITY_SCOPE).alias("scope_note"),
    )
    return joined.select(
        id_col,
        F.struct(value.alias("value"), F.bround(density_confidence(score, low, high), 3).alias("confidence"), evidence.alias("evidence"), F.lit("imagery_terms_per_line_v1").alias("method"), F.lit("prelabeled").alias("status")).alias("density"),
    )
