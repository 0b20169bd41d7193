"""Words of lines: the most probable way to cut a line by a dictionary with frequencies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quatrain.functions import text as X
from quatrain.functions.windows import Windows, signs_of
from quatrain.operators.lexicon import BLOCK_SIGNS, parts_of

#: Logarithms are taken in millionths and rounded down to integers, so sums are exact and ties are real.
UNIT = 1_000_000
UNKNOWN_TAG = "x"
#: Signs of lines that are cut together, and how many lines are worth a step of their own.
PART_SIGNS, FEW_LINES = 1 << 19, 40
#: Less than any sum of weights, and far from the end of 64 bits.
NEVER = -(1 << 61)


def best_cut(begins: np.ndarray, sizes: np.ndarray, arcs: dict[int, np.ndarray], unknown: int) -> tuple[np.ndarray, np.ndarray]:
    """The highest sum of weights up to each place, and the size of the last word on its path, of lines that begin at
    begins and take their size plus one places each. arcs: by size of word, the weight of the one that ends at each place,
    or NEVER; signs that are no word themselves weigh `unknown`. Of equal sums the path with the longer last word counts,
    position by position. All lines go on by one sign at a time; the few that are left in the end go on by themselves."""
    n = int(begins[-1] + sizes[-1]) + 1 if len(begins) else 0
    best, last = np.zeros(n, np.int64), np.ones(n, np.int32)
    single = np.maximum(arcs[1], unknown) if 1 in arcs else np.full(n, unknown, np.int64)
    longer = [(size, arcs[size]) for size in sorted(arcs) if size > 1]
    order = np.argsort(-sizes, kind="stable")
    begins, sizes = begins[order], sizes[order]
    most = int(sizes[0]) if len(sizes) else 0
    going = np.searchsorted(-sizes, -np.arange(1, most + 2), "right")
    end = 1
    while end <= most and going[end - 1] >= FEW_LINES:
        at = begins[: going[end - 1]] + end
        total, via = best[at - 1] + single[at], np.ones(len(at), np.int32)
        for size, weights in longer:
            if size > end:
                break
            other = best[at - size] + weights[at]
            better = other >= total
            total, via = np.where(better, other, total), np.where(better, np.int32(size), via)
        best[at], last[at] = total, via
        end += 1
    for begin, size in zip(begins[: going[end - 1]].tolist() if end <= most else (), sizes.tolist(), strict=False):
        line = slice(begin, begin + size + 1)
        sums, lasts, alone = best[line].tolist(), last[line].tolist(), single[line].tolist()
        held = [(k, weights[line].tolist()) for k, weights in longer]
        for e in range(end, size + 1):
            total, via = sums[e - 1] + alone[e], 1
            for k, weights in held:
                if weights[e] != NEVER and sums[e - k] + weights[e] >= total:
                    total, via = sums[e - k] + weights[e], k
            sums[e], lasts[e] = total, via
        best[line], last[line] = sums, lasts
    return best, last


def word_ends(begins: np.ndarray, sizes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Places where words of the best paths end, in order."""
    found, begin, at = [], begins, begins + sizes
    while True:
        going = at > begin
        begin, at = begin[going], at[going]
        if not len(at):
            break
        found.append(at)
        at = at - last[at]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def with_words(df: DataFrame, dictionary: DataFrame, lines, out: str = "words", block_signs: int = BLOCK_SIGNS) -> DataFrame:
    """df with, for each of lines (a column, array of string), its words as (word, tag), and the sum of their logarithms in
    millionths. dictionary: (word, freq, tag), freq 1 or more.

    A word's probability is its frequency over the sum of all; a sign that is no word counts once and has the tag x. The
    words of a line are found as windows of hashed blocks of block_signs signs at most, one pass each, and form a lattice;
    the best path through it is taken position by position, for many lines at once and for so many signs as PART_SIGNS, so
    a task's memory follows neither its rows nor its words. All of it is narrow: the dictionary travels, whatever its size,
    in parts of bounded size, and no row moves. Of a word that the dictionary repeats the highest frequency counts. Null
    lines have no words; an empty dictionary cuts lines into signs."""
    words = dictionary.where("word <> ''").groupBy("word").agg(F.max(F.struct("freq", F.coalesce("tag", F.lit(UNKNOWN_TAG)).alias("tag"))).alias("s")).select("word", "s.freq", "s.tag")
    sums = words.agg(F.sum("freq").alias("f"), F.sum(F.length("word")).alias("n"), F.floor(UNIT * F.log(F.sum("freq"))).alias("log")).first()
    log_total, n_blocks = sums["log"] or 0, max(1, -(-(sums["n"] or 0) // block_signs))
    weighed = words.select("word", (F.floor(UNIT * F.log("freq")) - F.lit(log_total)).cast("long").alias("weight"), "tag")
    # tags are parts of speech, a few dozen
    tags = sorted(r["tag"] for r in weighed.select("tag").distinct().collect())
    held = df.withColumn("__lines", lines).withColumn("__arcs", F.lit(None).cast("binary"))
    for block in range(n_blocks):
        own = weighed if n_blocks == 1 else weighed.where(F.pmod(F.xxhash64("word"), F.lit(n_blocks)) == block)
        known = df.sparkSession.sparkContext.broadcast(_Known(own.toArrow(), tags))
        held = held.mapInArrow(_arcs(known), held.schema) if block < n_blocks - 1 else held.mapInArrow(_cut(known, -log_total, tags), _with(held, out))
    return held.select(*df.columns, out)


def _with(held: DataFrame, out: str) -> T.StructType:
    cut = T._parse_datatype_string("struct<words:array<struct<word:string,tag:string>>,weight:bigint>")
    return T.StructType([f for f in held.schema.fields if f.name not in ("__lines", "__arcs")] + [T.StructField(out, T.ArrayType(cut))])


class _Known:
    """A block of the dictionary: its words, their weights and the numbers of their tags."""

    def __init__(self, rows: pa.Table, tags: list[str]):
        self.windows = Windows(rows.column("word").combine_chunks())
        self.weights = rows.column("weight").to_numpy()
        place = {t: i for i, t in enumerate(tags)}
        self.tags = np.fromiter((place[t] for t in rows.column("tag").to_pylist()), np.int64, rows.num_rows)

    def arcs(self, signs: np.ndarray) -> np.ndarray:
        """(end, size, weight, tag) of the words in signs."""
        start, size, number = self.windows.every(signs)
        return np.stack([start + size, size, self.weights[number], self.tags[number]], axis=1).astype(np.int64)


def _parts(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, list[str], np.ndarray]]:
    """Some rows of a batch at a time, with their lines in one list, and where a row's lines begin in it."""
    column = batch.column(at)
    flat = column.flatten().fill_null("")
    counts = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    upto = np.append(0, np.cumsum(counts))
    signs = np.append(0, np.cumsum(np.asarray(pa.compute.utf8_length(flat).to_numpy(zero_copy_only=False), np.int64) + 1))
    for a, b in parts_of(signs[upto[1:]] - signs[upto[:-1]], PART_SIGNS):
        yield batch.slice(a, b - a), flat.slice(upto[a], upto[b] - upto[a]).to_pylist(), upto[a : b + 1] - upto[a]


def _arcs(shipped):
    """Adds to each row's arcs those of one part of the dictionary, by places within the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for batch in batches:
            at = batch.schema.get_field_index("__arcs")
            for part, lines, rows in _parts(batch, at - 1):
                signs, begins = signs_of(lines)
                arcs, starts = known.arcs(signs), np.append(begins, len(signs))[rows]
                row = np.searchsorted(starts, arcs[:, 0] - arcs[:, 1], "right") - 1
                arcs[:, 0] -= starts[row]
                ends = np.searchsorted(row, np.arange(len(rows)))
                grown = [(old or b"") + arcs[a:b].tobytes() for old, a, b in zip(part.column(at).to_pylist(), ends[:-1], ends[1:], strict=True)]
                yield part.set_column(at, part.schema.field(at), pa.array(grown, part.schema.field(at).type))

    return run


def _cut(shipped, unknown: int, tags: list[str]):
    """The last part of the dictionary, and the words of the best paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, names = shipped.value, pa.array([*tags, UNKNOWN_TAG])  # signs that are no word have the last
        for batch in batches:
            at = batch.schema.get_field_index("__arcs")
            for part, lines, rows in _parts(batch, at - 1):
                signs, begins = signs_of(lines)
                starts = np.append(begins, len(signs))[rows]
                earlier = [np.frombuffer(x or b"", np.int64).reshape(-1, 4) + [s, 0, 0, 0] for x, s in zip(part.column(at).to_pylist(), starts, strict=False) if x]
                arcs = np.concatenate([known.arcs(signs), *earlier])
                weights, marks = {}, {}
                for size in np.unique(arcs[:, 1]).tolist():
                    own = arcs[arcs[:, 1] == size]
                    weights[size], marks[size] = np.full(len(signs), NEVER, np.int64), np.full(len(signs), len(tags), np.int32)
                    weights[size][own[:, 0]], marks[size][own[:, 0]] = own[:, 2], own[:, 3]
                sizes = np.diff(np.append(begins, len(signs))) - 1
                best, last = best_cut(begins, sizes, weights, unknown)
                ends = word_ends(begins, sizes, last)
                tag = np.full(len(ends), len(tags), np.int32)
                for size, mark in marks.items():
                    own = last[ends] == size
                    tag[own] = mark[ends[own]]
                column = part.column(at - 1)
                cut = _nested(lines, signs, begins, ends, names.take(pa.array(tag)), best[begins + sizes], rows, np.asarray(column.is_null().to_numpy(zero_copy_only=False), bool))
                kept = [i for i in range(part.num_columns) if i not in (at - 1, at)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), cut], schema=pa.schema([*(part.schema.field(i) for i in kept), pa.field("cut", cut.type)]))

    return run


def _nested(lines: list[str], signs: np.ndarray, begins: np.ndarray, ends: np.ndarray, tags: pa.Array, weights: np.ndarray, rows: np.ndarray, null: np.ndarray) -> pa.Array:
    """Rows of lines of words. Words share the lines' bytes, since each begins where the one ahead of it ends."""
    width = np.ones(len(signs), np.int64)
    for least in (0x80, 0x800, 0x10000):
        width += signs >= least
    width[begins + np.diff(np.append(begins, len(signs))) - 1] = 0
    offsets = np.append(0, np.append(0, np.cumsum(width))[ends]).astype(np.int32)
    word = pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer("".join(lines).encode()))
    # an end belongs to the line that begins ahead of it
    of_line = np.append(np.searchsorted(ends, begins), len(ends)).astype(np.int32)
    words = pa.ListArray.from_arrays(pa.array(of_line), pa.StructArray.from_arrays([word, tags], ["word", "tag"]))
    line = pa.StructArray.from_arrays([words, pa.array(weights, pa.int64())], ["words", "weight"])
    return pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), line, mask=pa.array(null) if null.any() else None)


def with_tags(df: DataFrame, dictionary: DataFrame, text_col: str = "text", out: str = "tags") -> DataFrame:
    """df with the tags of the words of each clean line, for scoring.check_parallel."""
    cut = with_words(df, dictionary, X.clean_lines(F.col(text_col)), "__cut")
    return cut.withColumn(out, F.transform("__cut", lambda line: F.transform(line["words"], lambda w: w["tag"]))).drop("__cut")
