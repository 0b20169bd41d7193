"""Token counts with a whole-token shortcut.

Before any text is read, on the driver, every vocabulary string that is shaped like a chunk (see pieces.chunks) is encoded
alone; those that come out as one token are kept in a table of at most the vocabulary's size, which tasks are sent. In
texts, chunks found in the table count one without any merging. Only the other chunks go to the library's merge procedure,
once per distinct chunk while the cache holds it. The cache is bounded in bytes, and chunks of more than LONG_CHUNK signs,
such as whole lines of a script without blanks, are not kept in it.

Segmentation decomposes at chunk borders because no piece reaches over one (PieceModel.splits_at_chunks proves it from
the model file, and read_model refuses other models), so the sums are the library's own counts.

Defined results: a null or empty text has no tokens; repeated rows are counted each; very long texts are counted whole; an
empty table gives an empty table; only the id columns and the text are read, so further columns of any name do not matter.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quatrain.llm.common import map_texts, text_or_empty
from quatrain.llm.pieces import SPACE, chunks, read_model

#: Bytes of chunks that a worker remembers besides the proven ones; beyond that it forgets them all and goes on.
CACHE_BYTES, LONG_CHUNK = 96_000_000, 64


@lru_cache(4)
def prove_single_tokens(model_path: str) -> dict[str, int]:
    """Chunks that are exactly one vocabulary string, and whose encoding alone is that one token, with their counts.

    A chunk after a line break carries the break, which is one byte token (or as many as the model gives it), so a
    proven bare string is kept with that cost added.
    """
    import sentencepiece

    model, lib = read_model(model_path), sentencepiece.SentencePieceProcessor(model_file=model_path)
    broken = len(lib.encode("\n")) - 1
    marked = [p for p in model.pieces if p.startswith(SPACE)]
    bare = [p for p in model.pieces if p and SPACE not in p]
    known = {}
    for p, ids in zip(marked, lib.encode([p[1:].replace(SPACE, " ") for p in marked], num_threads=1), strict=True):
        # encode() adds one blank itself, and gives nothing for the empty string
        if len(ids) == 1:
            known[p.replace(SPACE, " ")] = 1
    for p, ids in zip(bare, lib.encode(["\n" + p for p in bare], num_threads=1), strict=True):
        if len(ids) == broken + 2:
            known["\n" + p] = broken + 1
    return known


class ChunkCounts(dict):
    """Token counts by chunk: the proven table, and a bounded cache of merged chunks."""

    def __init__(self, model_path: str, proven: dict[str, int], cache: int = CACHE_BYTES):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.proven = dict(proven)
        # a blank mark without a word, as before a line break; encode("") gives nothing
        self.proven[" "] = len(self.lib.encode("\n ")) - len(self.lib.encode("\n"))
        self.most, self.held = cache, 0
        self.unseen: list[str] = []
        super().__init__(self.proven)

    def __missing__(self, chunk: str) -> int:
        self.unseen.append(chunk)
        return 0

    def merged(self, found: list[str]) -> dict[str, int]:
        """The library adds the first blank itself; before a line break that blank is a token of its own."""
        encoded = self.lib.encode([c if c[0] == "\n" else c[1:] for c in found], num_threads=1)
        return {c: len(ids) - (c[0] == "\n") for c, ids in zip(found, encoded, strict=True)}

    def count(self, texts: list[str]) -> list[int]:
        self.unseen = unseen = []
        sums, ends = [], []
        for t in texts:
            sums.append(sum(map(self.__getitem__, chunks(t))))
            ends.append(len(unseen))
        new = self.merged(list(set(unseen)))
        start = 0
        for i, end in enumerate(ends):
            if end > start:
                sums[i] += sum(map(new.__getitem__, unseen[start:end]))
            start = end
        kept = {c: n for c, n in new.items() if len(c) <= LONG_CHUNK}
        if self.held > self.most:
            self.clear()
            self.update(self.proven)
            self.held = 0
        self.update(kept)
        self.held += sum(150 + 4 * len(c) for c in kept)
        return sums


_counts: dict[str, ChunkCounts] = {}


def _worker_counts(model_path: str, proven: dict[str, int]) -> ChunkCounts:
    """Made once a Python worker; its tasks share what has been merged."""
    if model_path not in _counts:
        _counts[model_path] = ChunkCounts(model_path, proven)
    return _counts[model_path]


def count_tokens(
    df: DataFrame, model_path: str, text_col: str = "text", id_cols: tuple[str, ...] = ("doc_id",), limit: int = 4096
) -> DataFrame:
    """Id columns, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row."""

    proven = prove_single_tokens(model_path)

    def make():
        counts = _worker_counts(model_path, proven)
        return lambda texts: [pa.array(counts.count(texts), pa.int64())]

    sized = df.select(*id_cols, text_or_empty(text_col).alias("__body")).withColumn("n_bytes", F.octet_length("__body").cast("long"))
    out = map_texts(sized, [*id_cols, "n_bytes"], F.col("__body"), make, [T.StructField("n_tokens", T.LongType(), False)])
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
