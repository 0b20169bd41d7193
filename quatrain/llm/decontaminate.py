"""Benchmark decontamination: edit distance by CGK embedding and bit-sampling LSH.

An item has leaked into a document if some passage of the document is within MOST_EDITS times the item's words of the
item, counted in inserted, deleted or changed words (lower-cased runs of letters, digits and underscores; in Chinese and
Japanese script every sign is a word). Items of fewer than five words have leaked where their words stand unchanged.

The CGK embedding walks over a sequence and writes the word under its pointer at every step; a hash of step and word
says whether the pointer moves. Walks over two sequences that differ by edits fall into step again after each of them,
so few edits become a small Hamming distance. Sampling SAMPLES steps of the walk gives a key that near sequences share
with some probability, and REPEATS walks with keys of their own raise that to the recall wanted. Windows of exactly an
item's length are embedded and looked up among the items' keys; what meets is verified by exact alignment. An item of more than
LONG_WORDS words is looked for by its pieces: if the whole is within MOST_EDITS, so is one of its pieces, and the whole
item is then aligned.

Where windows begin: an item's first words hold a short run that its edits leave whole. Each of k edits breaks at most g
runs of g words, so of the first g*k+1 runs one stays; a window begins only where such a run puts an item's first word.
That leaves out no passage within k edits (one that has lost words before the run is embedded a few words askew, which
the walk takes as edits).

Scale: the operator is narrow over documents. Items are taken in blocks of about BLOCK_CHARS characters, so memory on
the driver and in tasks is bounded whatever the benchmark's size, and windows are no longer than pieces, whatever an
item's length. With more than one block documents are read once a block, each block's
leaks are written to the shared folder and only they are joined.

Defined results: null and empty texts have no leaks; null items and items without a word are no items; repeated documents
or items are reported each; empty tables give no leaks; very long texts are treated like any other; other columns are not
read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quatrain.llm.common import map_texts, materialize, text_or_empty

MOST_EDITS = 0.2
LONG_WORDS = 96
#: Found by simulation: a window at MOST_EDITS shares a key with probability 0.26 (60 words) to 0.55 (10 words) a walk,
#: so it is missed by all walks once in a thousand times or less.
REPEATS, SAMPLES = 48, 2
#: Samples lie in the first so many steps a word; walks move on every other step on average.
STEPS_PER_WORD = 1.0
BLOCK_CHARS = 8_000_000
#: Windows that are embedded at a time, and characters of the texts they come from.
WINDOWS, TEXT_CHARS = 4096, 1_000_000
SEED = 20_240_601

#: Fixed value: signs that are words of their own.
SIGNS = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(rf"[{SIGNS}]|[^\W{SIGNS}]+")
#: The same words in Spark's patterns.
JVM_WORD = r"(?U)[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{3ffff}]|[\w&&[^\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{3ffff}]]+"
PAST_END, PAST_TEXT = -1, -2
TWIST = np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def edits_to_passage(item: np.ndarray, text: np.ndarray) -> int:
    """Least edits between the item and any passage of the text."""
    size = len(text) + 1
    across = np.arange(size)
    row = np.zeros(size, np.int64)
    for i, w in enumerate(item.tolist(), 1):
        best = np.empty(size, np.int64)
        best[0] = i
        best[1:] = np.minimum(row[:-1] + (text != w), row[1:] + 1)
        row = np.minimum.accumulate(best - across) + across
    return int(row.min())


class LeakIndex:
    """Items of one block: vocabulary, pieces, runs that windows begin by, and keys of the pieces' walks."""

    def __init__(self, items: list[tuple[object, str]], repeats: int = REPEATS):
        self.repeats = repeats
        self.vocabulary: dict[str, int] = {}
        self.names, self.items = [], []
        for name, text in items:
            words = words_of(text or "")
            if words:
                self.names.append(name)
                self.items.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64))
        self.pieces, self.piece_item, self.piece_at = [], [], []
        for i, x in enumerate(self.items):
            cuts = np.linspace(0, len(x), -(-len(x) // LONG_WORDS) + 1).astype(np.int64).tolist()
            for a, b in zip(cuts, cuts[1:]):
                self.pieces.append(x[a:b])
                self.piece_item.append(i)
                self.piece_at.append(a)
        self.base = len(self.vocabulary) + 2
        rng = np.random.default_rng(SEED)
        self.longest = max(map(len, self.pieces), default=0)
        self.steps = int(STEPS_PER_WORD * self.longest) + 1
        self.mix = rng.integers(1, 1 << 63, (self.repeats, self.steps), np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = rng.integers(0, (1 << 64) - 1, (self.repeats, self.steps), np.uint64, endpoint=True)
        self.where = rng.random((SAMPLES, self.repeats))
        self.starts = {g: self._starts(g) for g in (1, 2, 3)}
        sizes = np.array([len(x) for x in self.pieces], np.int64)
        grid = np.full((len(self.pieces), max(1, self.longest)), PAST_END, np.int64)
        for row, x in zip(grid, self.pieces, strict=True):
            row[: len(x)] = x
        keys = np.concatenate([self.walk_keys(grid[at : at + WINDOWS], sizes[at : at + WINDOWS]) for at in range(0, max(1, len(sizes)), WINDOWS)], axis=1)
        self.owner = np.tile(np.arange(len(self.pieces)), (self.repeats, 1)).ravel()
        order = np.argsort(keys.ravel(), kind="stable")
        self.keys, self.owner = keys.ravel()[order], self.owner[order]

    @staticmethod
    def run_length(n: int) -> int:
        k = int(MOST_EDITS * n)
        return max(g for g in (1, 2, 3) if g == 1 or g * k + 1 <= n - g + 1)

    def _starts(self, g: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted (run, offset, item length) and distinct: where the run stands, how far the item's start lies behind."""
        found = set()
        for x in self.pieces:
            n = len(x)
            if self.run_length(n) == g:
                for o in range(min(g * int(MOST_EDITS * n) + 1, n - g + 1)):
                    found.add((self._run(x, o, g), o, n))
        rows = sorted(found)
        return np.array([r[0] for r in rows], np.int64), np.array([r[1:] for r in rows], np.int64).reshape(-1, 2)

    def _run(self, x: np.ndarray, o: int, g: int) -> int:
        key = 0
        for w in x[o : o + g].tolist():
            key = key * self.base + w
        return key

    def walk_keys(self, grid: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(repeats, windows) keys of sampled walks. grid: words of windows, sizes: their lengths."""
        n = len(sizes)
        at = np.zeros((self.repeats, n), np.int64)
        rows = np.arange(n)
        wanted = [np.floor(self.where[t][:, None] * STEPS_PER_WORD * sizes[None, :]).astype(np.int64) for t in range(SAMPLES)]
        key = np.broadcast_to(sizes[None, :].astype(np.uint64), (self.repeats, n)).copy()
        key += np.arange(self.repeats, dtype=np.uint64)[:, None] << np.uint64(32)
        last = int(max((w.max() for w in wanted if w.size), default=-1))
        width = grid.shape[1]
        for step in range(last + 1):
            seen = np.where(at < sizes, grid[rows, np.minimum(at, width - 1)], PAST_END).astype(np.uint64)
            for t in range(SAMPLES):
                here = wanted[t] == step
                key[here] = (key[here] ^ (seen[here] + TWIST[t])) * np.uint64(0xD6E8FEB86659FD93)
                key[here] ^= key[here] >> np.uint64(32)
            at += ((seen * self.mix[:, step : step + 1] + self.shift[:, step : step + 1]) >> np.uint64(63)).astype(np.int64)
        return key.view(np.int64)

    def windows(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Distinct (start, length, text) of windows to embed; ids: words of texts in a row, 0 for words of no item;
        bounds: where texts begin."""
        found = []
        for g, (runs, tails) in self.starts.items():
            if not len(runs) or len(ids) < g:
                continue
            m = len(ids) - g + 1
            known = ids[:m] > 0
            for k in range(1, g):
                known &= ids[k : m + k] > 0
            places = np.flatnonzero(known)
            key = np.zeros(len(places), np.int64)
            for k in range(g):
                key = key * self.base + ids[places + k]
            first, behind = np.searchsorted(runs, key), np.searchsorted(runs, key, "right")
            many = behind - first
            hit = np.repeat(np.arange(len(places)), many)
            tail = tails[np.repeat(first, many) + np.arange(len(hit)) - np.repeat(np.cumsum(many) - many, many)]
            text = np.searchsorted(bounds, places[hit], "right") - 1
            found.append(np.stack([places[hit] - tail[:, 0], tail[:, 1], text], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), np.int64)

    def leaks(self, texts: list[str]) -> list[list[tuple[object, int]]]:
        """Per text the items that leaked into it, with their edits."""
        out: list[list[tuple[object, int]]] = [[] for _ in texts]
        if not self.items:
            return out
        number = self.vocabulary.get
        rows = [np.fromiter(map(number, words_of(t), repeat(0)), np.int64) for t in texts]
        # texts stand apart, so no run reaches from one to the next
        bounds = np.cumsum([0] + [len(r) + 1 for r in rows])
        ids = np.zeros(int(bounds[-1]), np.int64)
        for b, r in zip(bounds, rows):
            ids[b : b + len(r)] = r
        found = self.windows(ids, bounds)
        if not len(found):
            return out
        best: dict[int, dict[int, int]] = defaultdict(dict)
        # places tried, by bins of as many words as an item may be shifted by
        tried: dict[tuple[int, int, int], list[int]] = defaultdict(list)
        for part in range(0, len(found), WINDOWS):
            starts, sizes, text = found[part : part + WINDOWS].T
            low, high = bounds[text], bounds[text + 1] - 1
            place = starts[:, None] + np.arange(self.longest)[None, :]
            inside = (place >= low[:, None]) & (place < high[:, None])
            grid = np.where(inside, ids[np.clip(place, 0, len(ids) - 1)], PAST_TEXT)
            keys = self.walk_keys(grid, sizes).ravel()
            first, behind = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, "right")
            many = behind - first
            window = np.repeat(np.tile(np.arange(len(starts)), self.repeats), many)
            item = self.owner[np.repeat(first, many) + np.arange(len(window)) - np.repeat(np.cumsum(many) - many, many)]
            for w, p in np.unique(np.stack([window, item], axis=1), axis=0).tolist():
                i, t = self.piece_item[p], int(text[w])
                n, begin = len(self.items[i]), int(starts[w]) - self.piece_at[p]
                k = int(MOST_EDITS * n)
                own = begin // (k + 1)
                if best[t].get(i, k + 1) == 0 or any(abs(begin - x) <= k for b in (own - 1, own, own + 1) for x in tried.get((t, i, b), ())):
                    continue
                tried[t, i, own].append(begin)
                a, b = max(int(low[w]), begin - 3 * k), min(int(high[w]), begin + n + 3 * k)
                # each of the item's words that is nowhere in the passage costs an edit
                if int((~np.isin(self.items[i], ids[a:b])).sum()) > k:
                    continue
                edits = edits_to_passage(self.items[i], ids[a:b])
                if edits <= k:
                    best[t][i] = min(edits, best[t].get(i, edits))
        for t, items in best.items():
            out[t] = sorted(((self.names[i], e) for i, e in items.items()), key=lambda x: (x[1], str(x[0])))
        return out


def mark_leaks(
    df: DataFrame, benchmark: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), item_col: str = "item_id", item_text_col: str = "text", leaks_col: str = "leaks", least_words: int = 1
) -> DataFrame:
    """Kept columns and leaks: an array of (item_id, edits), empty for clean documents. Items of fewer than least_words words
    are no items."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("body")).where("body is not null")
    if least_words > 1:
        items = items.where(F.regexp_count(F.lower("body"), F.lit(JVM_WORD)) >= least_words)
    kind = items.schema["item"].dataType
    leak = T.StructType([T.StructField("item_id", kind), T.StructField("edits", T.IntegerType(), False)])
    leaks = T.StructField("__leaks", T.ArrayType(leak, True), False)
    arrow = to_arrow_type(leaks.dataType)
    held = [f"__k{i}" for i in range(len(keep))]
    source = df.select(*[F.col(c).alias(h) for h, c in zip(held, keep, strict=True)], text_or_empty(text_col).alias("__body"))
    chars = items.agg(F.sum(F.length("body")).alias("n")).first()["n"] or 0
    n_blocks = max(1, -(-chars // BLOCK_CHARS))

    def block_leaks(rows: DataFrame, columns: list[str], block: int) -> DataFrame:
        own = items.where(F.pmod(F.xxhash64("item", "body"), F.lit(n_blocks)) == block).collect()
        index = LeakIndex([(r["item"], r["body"]) for r in own])

        def make():
            def work(texts: list[str]) -> list[pa.Array]:
                out, part, size = [], [], 0
                for t in texts:
                    if part and size + len(t) > TEXT_CHARS:
                        out += index.leaks(part)
                        part, size = [], 0
                    part.append(t)
                    size += len(t)
                out += index.leaks(part)
                return [pa.array([[{"item_id": i, "edits": e} for i, e in row] for row in out], arrow)]

            return work

        return map_texts(rows, columns, F.col("__body"), make, [leaks])

    if n_blocks == 1:
        out = block_leaks(source, held, 0)
    else:
        rows, _ = materialize(source.withColumn("__row", F.monotonically_increasing_id()), "texts")
        found = None
        for block in range(n_blocks):
            part, _ = materialize(block_leaks(rows, ["__row"], block).where(F.size("__leaks") > 0), f"leaks{block}")
            found = part if found is None else found.unionByName(part)
        found = found.groupBy("__row").agg(F.flatten(F.collect_list("__leaks")).alias("__leaks"))
        none = F.array().cast(leaks.dataType)
        out = rows.join(found, "__row", "left").withColumn("__leaks", F.coalesce("__leaks", none))
    return out.select(*[F.col(h).alias(c) for h, c in zip(held, keep, strict=True)], F.col("__leaks").alias(leaks_col))


def find_leaks(df: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document and leaked item: id, item_id, edits."""
    marked = mark_leaks(df, benchmark, text_col, (id_col,))
    return marked.select(id_col, F.explode("leaks").alias("x")).select(id_col, "x.item_id", "x.edits")
