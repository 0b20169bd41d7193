"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The machine is a cascade of three transducers over the tropical semiring:

* the normaliser (blank to blank mark, one blank mark in front; the identity else), compiled to a table of signs,
* the pieces: from the state "last piece was a" an arc reads the signs of piece b, writes b's id and leads to the state
  "last piece was b",
* byte fallback: an arc for each sign that no piece has, writing the ids of its UTF-8 bytes.

Composed with an input it is a lattice whose states are (position, last piece), and the result is what the path of least
weight writes (PieceTransducer.shortest). Arc weights of a unigram model are the negated scores, so the shortest path is
the best segmentation. In a merge (BPE) model scores are merge ranks, and
summing them does not give the merge result. Its arcs weigh 0 where the merge procedure keeps the border between a and
b and infinity where some merge would cross it. A sequence of pieces is the merge result exactly if no neighbouring
pair has a merge over its border, because nothing outside the two pieces acts before the first such merge; so the one
path of finite weight is the library's result. Whether a border holds is found by undoing the two pieces' last merges in
turn, latest first, and asking whether the two signs groups that face each other would have merged before that.

Inputs fall into chunks (pieces.chunks), and chunks are composed once while a cache holds them that is bounded in bytes.
Texts without blanks, whose chunks are whole lines, take no cache.

Defined results: a null or empty text encodes to no ids and decodes to the empty text; very long texts are encoded whole; the decoded text is the text with
blank marks read as blanks; repeated rows are encoded each; an empty table gives an empty table; columns that are not
asked for are not read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quatrain.llm.common import map_texts, text_or_empty
from quatrain.llm.pieces import BYTE, NORMAL, SPACE, PieceModel, chunks, read_model

#: Bytes that chunks and their ids may take in each half of a cache; longer chunks than LONG_CHUNK signs are not kept.
CACHE_BYTES, LONG_CHUNK = 64_000_000, 64
CACHE_BORDERS, CACHE_LENGTHS = 400_000, 300_000


class ArcLengths(dict):
    """By the next three signs: the lengths, longest first, of pieces that begin so."""

    def __init__(self, pieces):
        super().__init__()
        self.pieces, self.long = pieces, {}
        for p in pieces:
            if len(p) > 2:
                self.long.setdefault(p[:3], set()).add(len(p))

    def __missing__(self, begin: str) -> tuple[int, ...]:
        if len(self) >= CACHE_LENGTHS:
            self.clear()
        short = {n for n in (1, 2) if len(begin) >= n and begin[:n] in self.pieces}
        self[begin] = found = tuple(sorted(self.long.get(begin, set()) | short, reverse=True))
        return found


class Composed(dict):
    """What chunks write, as bytes of their ids; composed when they are first asked for. Of the most recent ones twice
    the bound is held, in bytes: when one half is full the other is forgotten. Long chunks, such as whole lines of a
    script without blanks, seldom come again and are composed each time."""

    def __init__(self, compose, most: int):
        super().__init__()
        self.compose, self.most, self.held, self.older = compose, most, 0, {}

    def __missing__(self, chunk: str) -> bytes:
        found = self.older.get(chunk)
        if found is None:
            found = array("i", self.compose(chunk)).tobytes()
        if len(chunk) > LONG_CHUNK:
            return found
        if self.held >= self.most:
            self.older, self.held = dict(self), 0
            self.clear()
        self.held += 200 + 4 * len(chunk) + len(found)
        self[chunk] = found
        return found


#: State of the piece machine before any piece, and of a unigram machine throughout.
START = -1
INFINITE = float("inf")


class PieceTransducer:
    def __init__(self, model: PieceModel, cache: int = CACHE_BYTES):
        self.model = model
        self.ids = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == NORMAL}
        self.bytes = model.byte_ids
        self.unknown = next((i for i, k in enumerate(model.kinds) if k == 2), 0)
        self.normaliser = {ord(" "): SPACE}
        self.signs = {s for p in self.ids for s in p}
        self.cost = [-s for s in model.scores]
        #: what the library adds for a sign that no piece has
        self.fallback_cost = 10.0 - min((s for s, k in zip(model.scores, model.kinds, strict=True) if k == NORMAL), default=0.0)
        self.borders: dict[int, float] = {}
        self.known = Composed(self.compose, cache)
        self.arcs, self.lengths = self.ids, ArcLengths(self.ids)
        if model.bpe:
            self._compile_merges()

    def _compile_merges(self) -> None:
        """Rank and last merge of each piece that the merge procedure can make; other pieces get no arc."""
        score, ids = self.model.scores, self.ids
        order = sorted({score[i] for i in ids.values()}, reverse=True)
        place = {s: n for n, s in enumerate(order)}
        self.rank = {p: place[score[i]] for p, i in ids.items()}
        self.halves: dict[str, tuple[str, str] | None] = {}
        for p in ids:
            parts, last = list(p), None
            while len(parts) > 1:
                best, where = None, -1
                for k in range(len(parts) - 1):
                    r = self.rank.get(parts[k] + parts[k + 1])
                    if r is not None and (best is None or r < best):
                        best, where = r, k
                if best is None:
                    break
                last = (parts[where], parts[where + 1])
                parts[where : where + 2] = [last[0] + last[1]]
            if len(parts) == 1:
                self.halves[p] = last
        # the machine's arcs, by numbers: facing pieces that merge, each piece's halves, and piece lengths by last two signs
        self.joint = {}
        for p in self.halves:
            for k in range(1, len(p)):
                left, right = p[:k], p[k:]
                if left in self.halves and right in self.halves:
                    self.joint[ids[left] << 32 | ids[right]] = self.rank[p]
        self.made = {ids[p]: (self.rank[p] if h else -1) for p, h in self.halves.items()}
        self.parts = {ids[p]: (ids[h[0]], ids[h[1]]) if h else (-1, -1) for p, h in self.halves.items()}
        self.arcs = {p: ids[p] for p in self.halves}
        self.lengths = ArcLengths(self.halves)

    def holds(self, left: int, right: int) -> bool:
        """No merge crosses the border between the two pieces."""
        joint, made, parts = self.joint.get, self.made, self.parts
        # a crossing merge counts if it comes before the merge that made one of the groups: by rank, the left one first
        before, wins_tie = 1 << 60, False
        while True:
            crossing = joint(left << 32 | right)
            if crossing is not None and (crossing < before or wins_tie and crossing == before):
                return False
            a, b = made[left], made[right]
            if a > b:
                before, wins_tie, left = a, False, parts[left][1]
            elif b >= 0:
                before, wins_tie, right = b, True, parts[right][0]
            else:
                return True

    def weight(self, last: int, piece: int) -> float:
        """Of the arc that reads the piece after the last one; negative numbers are signs without a piece."""
        if not self.model.bpe:
            return self.cost[piece] if piece >= 0 else self.fallback_cost
        if last < 0 or piece < 0:
            return 0.0  # nothing merges over the border of such a sign
        key = last << 32 | piece
        found = self.borders.get(key)
        if found is None:
            if len(self.borders) >= CACHE_BORDERS:
                self.borders.clear()
            found = self.borders[key] = 0.0 if self.holds(last, piece) else INFINITE
        return found

    def _out(self, text: str, at: int) -> Iterator[tuple[int, int]]:
        """Arcs of the piece and fallback machines that read the text from a position: signs read, and what is written;
        longest first."""
        arcs, left = self.arcs.get, len(text) - at
        for n in self.lengths[text[at : at + 3]]:
            if n <= left:
                piece = arcs(text[at : at + n])
                if piece is not None:
                    yield n, piece
        if text[at] not in self.signs:
            yield 1, -2 - ord(text[at])

    def shortest(self, text: str) -> list[int]:
        """What the path of least weight through the lattice writes: ids; -2 minus the code point for a sign without a
        piece. Of equal weights the path stays that was found first."""
        return self._first_of_weight_zero(text) if self.model.bpe else self._least_of_all(text)

    def _least_of_all(self, text: str) -> list[int]:
        """By position: the least weight, and the arc that it comes by."""
        best: list[tuple[float, int, int]] = [(0.0, 0, START)] + [(INFINITE, 0, START)] * len(text)
        for at in range(len(text)):
            for n, piece in self._out(text, at):
                total = best[at][0] + self.weight(START, piece)
                if total < best[at + n][0]:
                    best[at + n] = (total, at, piece)
        path, at = [], len(text)
        while at:
            path.append(best[at][2])
            at = best[at][1]
        return path[::-1]

    def _first_of_weight_zero(self, text: str) -> list[int]:
        """Weights are zero or infinite, so the first whole path of weight zero is a shortest one: best-first search, which
        here takes the furthest state first and makes its arcs as they are asked for. The part of a text before a position
        has one such path as well, so a position from which the search came back once needs no second visit."""
        size, weight, out = len(text), self.weight, self._out
        path, ways, places, dead, at = [START], [out(text, 0)] if size else [], [0], set(), 0
        while at < size:
            last = path[-1]
            for n, piece in ways[-1]:
                if at + n not in dead and weight(last, piece) == 0.0:
                    path.append(piece)
                    at += n
                    places.append(at)
                    if at < size:
                        ways.append(out(text, at))
                    break
            else:
                dead.add(at)
                path.pop()
                ways.pop()
                places.pop()
                at = places[-1]
        return path[1:]

    def compose(self, chunk: str) -> list[int]:
        """Ids that the cascade writes for one chunk."""
        out: list[int] = []
        for piece in self.shortest(chunk.translate(self.normaliser)):
            if piece >= 0:
                out.append(piece)
            elif self.bytes:
                out += [self.bytes[b] for b in chr(-2 - piece).encode("utf-8")]
            else:
                out.append(self.unknown)
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.known.__getitem__, chunks(text))), np.int32)

    def output_bytes(self) -> list[bytes]:
        """What each id writes in the inverse machine; control and unknown pieces write what the library writes."""
        return [
            bytes([int(p[3:5], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == 2 else b"" if k == 3 else p.replace(SPACE, " ").encode("utf-8")
            for p, k in zip(self.model.pieces, self.model.kinds, strict=True)
        ]

    def decode_rows(self, flat: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts that rows of ids write; row k is flat[ends[k]:ends[k + 1]]."""
        if not hasattr(self, "written"):
            self.written = pa.array(self.output_bytes(), pa.large_binary())
            self.sizes = np.array([len(b) for b in self.output_bytes()], np.int64)
        data = self.written.take(pa.array(flat)).buffers()[2]
        all_bytes = data.to_pybytes() if data is not None else b""
        at = np.concatenate([[0], np.cumsum(self.sizes[flat])])[ends].tolist()
        texts = [all_bytes[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]
        return [t[1:] if t.startswith(" ") else t for t in texts]

    def decode(self, ids) -> str:
        return self.decode_rows(np.array(ids, np.int32), np.array([0, len(ids)]))[0]


@lru_cache(1)
def machine_of(model_path: str) -> PieceTransducer:
    """Compiled once a Python worker; its tasks share what has been composed."""
    return PieceTransducer(read_model(model_path))


def encode_texts(df: DataFrame, model_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """Kept columns, ids (array of int) and the text decoded from the ids again."""

    def make():
        machine = machine_of(model_path)

        def work(texts: list[str]) -> list[pa.Array]:
            rows = [machine.encode(t) for t in texts]
            ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(machine.decode_rows(flat, ends), pa.string())]

        return work

    fields = [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False), T.StructField(decoded_col, T.StringType(), False)]
    return map_texts(df, list(keep), text_or_empty(text_col), make, fields)
