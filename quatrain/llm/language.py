"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A text is its words (runs of letters,
lower-cased); a word's probability in a language is the sum, over all ways to cut the word into pieces, of the product of
the pieces' probabilities, which the forward algorithm takes in one pass over the word. A sign that is no piece is read as
its byte pieces. A text's score is the sum of its words' logarithms and the language's prior; the prediction is the language
with the highest posterior.

Learning: the classifier is fitted to a sample of about FIT_ROWS labelled rows a language that are not held out (all rows
of a language that has fewer), chosen by a hash of the id in one pass. Their words are counted by language with partial
aggregation. From equal probabilities, STEPS rounds of expectation and maximisation follow: expected uses of each piece
come from forward and backward sums over the written word table, in a distributed pass that gives at most one row a piece
and language. Expectations are summed as integers (thousandths), so a repeated task, or rows in another order, give the
same model.

A document is held out if the CRC32 of its id as text is 2 modulo 4. Held-out texts and rows without a label teach nothing;
labels, sources and ids are no inputs of a prediction.

Scale: one shuffle of the sample's word counts; prediction is narrow. The driver and each task hold one number a piece and
language: the vocabulary is fixed, and languages are few. Runs of more than WORD_LETTERS letters are scored in parts of
that length, which bounds memory for texts without blanks; words are remembered by bytes (CACHE_BYTES a task). Words of
one length are summed side by side, as products; words with signs that are no pieces, and words of more than SHORT letters,
whose products would vanish, as logarithms of single lattices.

Defined results: a null text, or one without a letter, is `und` with score 0; if nothing can be learnt every text is; ties
go to the lesser label; a null id counts as the empty text, which is not held out; repeated rows get equal rows and teach
as often as they occur; very long texts are read whole; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quatrain.llm.common import map_texts, materialize, text_or_empty
from quatrain.llm.pieces import BYTE, NORMAL, SPACE, read_model

STEPS = 4
FIT_ROWS = 4000
#: Uses that every piece has in every language besides those expected.
SMOOTH = 0.1
WORD_LETTERS, SHORT = 256, 24
#: Words that a task counts before it hands them on, cells of lattices that are summed at a time, bytes of words remembered.
COUNTED, CELLS, CACHE_BYTES = 400_000, 1_000_000, 128_000_000
UNIT = 1000
TWIST = np.uint64(0x9E3779B97F4A7C15)
UNDETERMINED = "und"
#: Fixed by the contract of the query.
FOLDS, HELD_OUT = 4, 2

_RUN = re.compile(r"[^\W\d_]+")
#: ASCII signs but lower-case letters become blanks.
_BETWEEN = bytes(b for b in range(128) if not 97 <= b <= 122)
_BLANK = bytes.maketrans(_BETWEEN, b" " * len(_BETWEEN))


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters, in parts of WORD_LETTERS at most."""
    out = []
    for run in _RUN.findall(text.lower()):
        for part in [run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split():
            out += [part] if len(part) <= WORD_LETTERS else [part[i : i + WORD_LETTERS] for i in range(0, len(part), WORD_LETTERS)]
    return out


class Pieces:
    """A vocabulary's pieces, and the lattice of a word."""

    def __init__(self, model_path: str):
        model = read_model(model_path)
        self.size = len(model.pieces)
        self.ids = {p.lower(): i for i, (p, k) in reversed(list(enumerate(zip(model.pieces, model.kinds, strict=True)))) if k == NORMAL and p == p.lower()}
        self.usable = np.array(sorted([*self.ids.values(), *(i for i, k in enumerate(model.kinds) if k == BYTE)]))
        self.bytes = model.byte_ids
        self.longest = max(map(len, self.ids), default=1)
        # by length: sorted keys of the pieces, and their ids; the last row of a table of probabilities is for no piece
        self.keyed = []
        for n in range(1, self.longest + 1):
            found = [p for p in self.ids if len(p) == n]
            keys = np.zeros(len(found), np.uint64)
            for k in range(n):
                keys = keys * TWIST + np.array([ord(p[k]) for p in found], np.uint64)
            order = np.argsort(keys)
            self.keyed.append((keys[order], np.array([self.ids[found[i]] for i in order], np.int64)))

    def runs(self, codes: np.ndarray) -> list[np.ndarray]:
        """By length from 1: (words, begins) ids of the pieces that stand there, size for none. codes: words of one length."""
        out, keys = [], np.zeros(codes.shape, np.uint64)
        for n in range(1, min(self.longest, codes.shape[1]) + 1):
            keys = keys[:, : codes.shape[1] - n + 1] * TWIST + codes[:, n - 1 :]
            known, ids = self.keyed[n - 1]
            if not len(known):
                out.append(np.full(keys.shape, self.size))
                continue
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            out.append(np.where(known[at] == keys, ids[at], self.size))
        return out

    def arcs(self, word: str) -> tuple[int, list[tuple[int, int, int]]]:
        """Number of steps, and (begin, end, piece) in order of begin. A step is a sign, or a byte of a sign without a piece."""
        ids, arcs, at = self.ids, [], 0
        marked = SPACE + word
        n = len(marked)
        for i, sign in enumerate(marked):
            if sign not in ids:
                for b in sign.encode("utf-8"):
                    arcs.append((at, at + 1, self.bytes[b]))
                    at += 1
                continue
            for j in range(i + 1, min(n, i + self.longest) + 1):
                if marked[j - 1] not in ids:
                    break
                piece = ids.get(marked[i:j])
                if piece is not None:
                    arcs.append((at, at + j - i, piece))
            at += 1
        return at, arcs


@lru_cache(maxsize=2)
def pieces_of(model_path: str) -> Pieces:
    return Pieces(model_path)


class Lattices:
    """Lattices of several words side by side: arcs by their ends and by their begins."""

    def __init__(self, pieces: Pieces, words: list[str]):
        self.steps, rows = np.zeros(len(words), np.int64), []
        for w, word in enumerate(words):
            self.steps[w], arcs = pieces.arcs(word)
            rows += [(w, *a) for a in arcs]
        self.word, self.begin, self.end, self.piece = np.array(rows, np.int64).reshape(-1, 4).T
        self.most = int(self.steps.max(initial=0))

    def _sweep(self, log_p: np.ndarray, near: np.ndarray, far: np.ndarray, places: range, start: np.ndarray) -> np.ndarray:
        """Logarithms of sums over paths, place by place, from the arcs that leave each place for near to those at far."""
        sums = np.full((len(self.steps), self.most + 1, log_p.shape[1]), -np.inf)
        sums[np.arange(len(self.steps)), start] = 0.0
        order = np.lexsort((self.word, near))
        cuts = np.searchsorted(near[order], np.arange(self.most + 2))
        for place in places:
            at = order[cuts[place] : cuts[place + 1]]
            if len(at):
                owner = self.word[at]
                first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                sums[owner[first], place] = np.logaddexp.reduceat(sums[owner, far[at]] + log_p[self.piece[at]], first, axis=0)
        return sums

    def forward(self, log_p: np.ndarray) -> np.ndarray:
        return self._sweep(log_p, self.end, self.begin, range(1, self.most + 1), np.zeros(len(self.steps), np.int64))

    def backward(self, log_p: np.ndarray) -> np.ndarray:
        return self._sweep(log_p, self.begin, self.end, range(self.most - 1, -1, -1), self.steps)

    def totals(self, forward: np.ndarray) -> np.ndarray:
        return forward[np.arange(len(self.steps)), self.steps]

    def expected(self, log_p: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
        """(pieces, languages): expected uses in units; counts: (words, languages)."""
        a, b = self.forward(log_p), self.backward(log_p)
        share = np.exp(a[self.word, self.begin] + log_p[self.piece] + b[self.word, self.end] - self.totals(a)[self.word])
        uses = np.rint(share * counts[self.word] * UNIT).astype(np.int64)
        out = np.zeros((size, counts.shape[1]), np.int64)
        np.add.at(out, self.piece, uses)
        return out


class Ranks:
    """The same of words of one length without other signs, side by side and without logarithms."""

    def __init__(self, runs: list[np.ndarray], p: np.ndarray):
        """runs: as Pieces.runs() gives them; p: probabilities, with a last row of zeros."""
        self.runs, self.p = runs, p
        self.words, self.steps = runs[0].shape

    def forward(self) -> np.ndarray:
        sums = np.zeros((self.steps + 1, self.words, self.p.shape[1]))
        sums[0] = 1.0
        for end in range(1, self.steps + 1):
            for n in range(1, min(end, len(self.runs)) + 1):
                sums[end] += sums[end - n] * self.p[self.runs[n - 1][:, end - n]]
        return sums

    def expected(self, counts: np.ndarray) -> np.ndarray:
        a, size = self.forward(), len(self.p) - 1
        b, out = np.zeros_like(a), np.zeros((size, counts.shape[1]), np.int64)
        b[self.steps] = counts / a[self.steps]
        for begin in range(self.steps - 1, -1, -1):
            for n in range(1, min(self.steps - begin, len(self.runs)) + 1):
                piece = self.runs[n - 1][:, begin]
                there = np.flatnonzero(piece < size)
                if len(there):
                    piece = piece[there]
                    rest = self.p[piece] * b[begin + n, there]
                    b[begin, there] += rest
                    uses = np.rint(a[begin, there] * rest * UNIT)
                    for k in range(counts.shape[1]):
                        out[:, k] += np.bincount(piece, uses[:, k], size).astype(np.int64)
        return out


def in_ranks(pieces: Pieces, words: list[str], languages: int) -> Iterator[tuple[np.ndarray, list[np.ndarray] | None]]:
    """Places of words that are summed together: with their runs, or None where each needs a lattice."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    odd = [np.flatnonzero(sizes > SHORT)]
    for n in np.unique(sizes[sizes <= SHORT]).tolist():
        same, most = np.flatnonzero(sizes == n), max(1, CELLS // ((n + 2) * languages))
        for at in range(0, len(same), most):
            part = same[at : at + most]
            codes = np.frombuffer("".join([SPACE + words[i] for i in part]).encode("utf-32-le"), np.uint32).reshape(len(part), n + 1).astype(np.uint64)
            runs = pieces.runs(codes)
            known = (runs[0] < pieces.size).all(1)
            if known.any():
                yield part[known], [r[known] for r in runs]
            odd.append(part[~known])
    odd = np.concatenate(odd)
    odd = odd[np.argsort(sizes[odd], kind="stable")]
    at = 0
    while at < len(odd):
        n = 1
        while at + n < len(odd) and (n + 1) * (4 * sizes[odd[at + n]] + 2) * languages <= CELLS:
            n += 1
        yield odd[at : at + n], None
        at += n


def _with_none(log_p: np.ndarray) -> np.ndarray:
    return np.concatenate([np.exp(log_p), np.zeros((1, log_p.shape[1]))])


def word_log_probabilities(pieces: Pieces, words: list[str], log_p: np.ndarray) -> np.ndarray:
    """(words, languages)."""
    out, p = np.zeros((len(words), log_p.shape[1])), _with_none(log_p)
    for at, runs in in_ranks(pieces, words, log_p.shape[1]):
        if runs is None:
            lattices = Lattices(pieces, [words[i] for i in at])
            out[at] = lattices.totals(lattices.forward(log_p))
        else:
            out[at] = np.log(Ranks(runs, p).forward()[-1])
    return out


def expected_uses(pieces: Pieces, words: list[str], counts: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """(pieces, languages): expected uses in units; counts: (words, languages)."""
    out, p = np.zeros((pieces.size, counts.shape[1]), np.int64), _with_none(log_p)
    for at, runs in in_ranks(pieces, words, counts.shape[1]):
        out += Lattices(pieces, [words[i] for i in at]).expected(log_p, counts[at], pieces.size) if runs is None else Ranks(runs, p).expected(counts[at])
    return out


def count_words(df: DataFrame, text, label) -> DataFrame:
    """(word, label, n) of a table's texts."""
    source = df.select(text.alias("t"), label.cast("string").alias("l"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def packed() -> pa.RecordBatch:
            rows = [(w, name, n) for name, words in found.items() for w, n in words.items()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64()))], names=["word", "label", "n"])

        for batch in batches:
            for text, name in zip(batch.column(0), batch.column(1), strict=True):
                found.setdefault(name.as_py(), Counter()).update(words_of(text.as_py()))
            if sum(map(len, found.values())) > COUNTED:
                yield packed()
                found.clear()
        yield packed()

    return source.mapInArrow(run, "word string, label string, n long").groupBy("word", "label").agg(F.sum("n").alias("n"))


def _expected_uses(words: DataFrame, model_path: str, labels: list[str], log_p: np.ndarray) -> DataFrame:
    """(piece, label number, uses) over the word table."""
    place = {name: k for k, name in enumerate(labels)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model_path)
        uses = np.zeros((pieces.size, len(labels)), np.int64)
        for batch in batches:
            names, each = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            counts = np.zeros((len(names), len(labels)))
            for row, found in zip(counts, each, strict=True):
                for x in found:
                    row[place[x["label"]]] = x["n"]
            uses += expected_uses(pieces, names, counts, log_p)
        piece, label = np.nonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(label), pa.array(uses[piece, label])], names=["piece", "label", "uses"])

    return words.mapInArrow(run, "piece long, label long, uses long").groupBy("piece", "label").agg(F.sum("uses").alias("uses"))


def sampled(rows: DataFrame, sizes: dict[str, int], label_col: str, id_col: str, fit_rows: int) -> DataFrame:
    """About fit_rows rows a label by a hash of their ids; all rows of labels that have no more."""
    share = F.coalesce(*[F.when(F.col(label_col).cast("string") == k, F.lit(fit_rows / n)) for k, n in sizes.items() if n > fit_rows], F.lit(1.0))
    return rows.where((F.pmod(F.xxhash64(F.lit("fit"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(1 << 20)) / F.lit(float(1 << 20))) < share)


def learn(
    df: DataFrame, model_path: str, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", steps: int = STEPS, fit_rows: int = FIT_ROWS
) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Labels, logarithms of their priors, and (pieces, labels) logarithms of probabilities, from rows with a label."""
    rows = df.where(F.col(label_col).isNotNull())
    priors = {r["l"]: r["n"] for r in rows.groupBy(F.col(label_col).cast("string").alias("l")).agg(F.count("*").alias("n")).collect()}
    chosen = sampled(rows, priors, label_col, id_col, fit_rows)
    counted, _ = materialize(count_words(chosen, text_or_empty(text_col), F.col(label_col)), "words")
    words, _ = materialize(counted.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("label", "n"))).alias("each")), "vocabulary")
    labels = sorted(priors)
    pieces = pieces_of(model_path)
    log_p = np.full((pieces.size, len(labels)), -np.log(len(pieces.usable)))
    for _ in range(steps if labels else 0):
        uses = np.zeros((pieces.size, len(labels)))
        for r in _expected_uses(words, model_path, labels, log_p).collect():
            uses[r["piece"], r["label"]] = r["uses"] / UNIT
        uses[pieces.usable] += SMOOTH
        with np.errstate(divide="ignore"):
            log_p = np.log(uses) - np.log(uses.sum(0))
    n = np.array([priors[x] for x in labels], np.float64)
    return labels, np.log(n / n.sum()), log_p


class Scorer:
    """Posteriors of texts. Texts are cut at ASCII signs first; what such a part adds is remembered, up to a number of bytes."""

    def __init__(self, model_path: str, labels: list[str], priors: np.ndarray, log_p: np.ndarray, cache_bytes: int = CACHE_BYTES):
        self.pieces, self.labels, self.priors, self.log_p = pieces_of(model_path), labels, priors, log_p
        self.cache_bytes = cache_bytes
        self._forget()

    def _forget(self) -> None:
        #: the first row is for parts without a letter
        self.place: dict[bytes, int] = {}
        self.table, self.held = np.zeros((1, len(self.labels))), 0

    def _add(self, parts: set[bytes]) -> None:
        if self.held > self.cache_bytes:
            self._forget()
        new = [p for p in parts if p not in self.place]
        if not new:
            return
        words = [words_of(p.decode("utf-8")) for p in new]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        each = word_log_probabilities(self.pieces, [w for ws in words for w in ws], self.log_p)
        some = np.flatnonzero(sizes)
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])[some]
        begin = len(self.table)
        for p, n in zip(new, sizes.tolist(), strict=True):
            self.place[p] = begin if n else 0
            begin += n > 0
        if len(some):
            self.table = np.concatenate([self.table, np.add.reduceat(each, begins, axis=0)])
        self.held += sum(150 + len(p) + 8 * len(self.labels) for p in new)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.labels:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        counted = [Counter(t.lower().encode("utf-8").translate(_BLANK).split()) for t in texts]
        self._add(set().union(*counted))
        names, scores = [], []
        for found in counted:
            at = np.fromiter(map(self.place.__getitem__, found), np.int64, len(found))
            if not at.any():
                names.append(UNDETERMINED)
                scores.append(0.0)
                continue
            total = np.fromiter(found.values(), np.float64, len(found)) @ self.table[at] + self.priors
            shares = np.exp(total - total.max())
            best = int(shares.argmax())
            names.append(self.labels[best])
            scores.append(float(shares[best] / shares.sum()))
        return names, scores


def is_held_out(id_col: str, folds: int = FOLDS, held_out: int = HELD_OUT):
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "utf-8")) % folds == held_out


def identify_languages(df: DataFrame, model_path: str, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", steps: int = STEPS, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Every row's id, held_out, lang_pred and score (posterior of the prediction)."""
    labels, priors, log_p = learn(df.where(~is_held_out(id_col)), model_path, text_col, label_col, id_col, steps, fit_rows)

    def make():
        scorer = Scorer(model_path, labels, priors, log_p)

        def work(texts: list[str]) -> list[pa.Array]:
            names, scores = scorer.predict(texts)
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return work

    source = df.select(F.col(id_col).alias("__id"), is_held_out(id_col).alias("held_out"), text_or_empty(text_col).alias("__body"))
    fields = [T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)]
    out = map_texts(source, ["__id", "held_out"], F.col("__body"), make, fields)
    return out.select(F.col("__id").alias(id_col), "held_out", "lang_pred", "score")
