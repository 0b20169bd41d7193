"""A SentencePiece model file read without the library: normaliser settings, pieces and how texts fall into chunks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

#: A chunk: blanks with the word after them, or a line break with the word after it.
CHUNK = re.compile(r"\n[^ \n]*| +[^ \n]*")


def _fields(data: bytes):
    """(field number, value) pairs of a protobuf message; nested messages stay bytes."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + n]
            at += n


@dataclass
class PieceModel:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    bpe: bool = False
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    charsmap: bytes = b""

    @property
    def byte_ids(self) -> dict[int, int]:
        return {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}

    def splits_at_chunks(self) -> bool:
        """Proof by exhaustion that no piece reaches over a chunk border: none has a blank mark after another sign
        or holds a line break. Segmentations of neighbouring chunks are then independent."""
        return all(
            not re.search(f"[^{SPACE}]{SPACE}", p) and "\n" not in p and " " not in p
            for p, k in zip(self.pieces, self.kinds, strict=True)
            if k in (NORMAL, USER_DEFINED, UNUSED)
        )


def read_model(path: str) -> PieceModel:
    """Raises ValueError for models whose normaliser is not the identity or whose pieces cross chunk borders."""
    import struct

    with open(path, "rb") as f:
        data = f.read()
    m = PieceModel()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append(piece)
            m.scores.append(score)
            m.kinds.append(kind)
        elif number == 2:
            m.bpe = dict(_fields(value)).get(3, 1) == 2
        elif number == 3:
            spec = dict(_fields(value))
            m.charsmap = spec.get(2, b"")
            m.add_dummy_prefix = bool(spec.get(3, 1))
            m.remove_extra_whitespaces = bool(spec.get(4, 1))
            m.escape_whitespaces = bool(spec.get(5, 1))
    if m.charsmap or m.remove_extra_whitespaces or not m.escape_whitespaces or not m.add_dummy_prefix:
        raise ValueError("only models with the identity normaliser, a dummy prefix and kept white space are supported")
    if USER_DEFINED in m.kinds or UNUSED in m.kinds or not m.splits_at_chunks():
        raise ValueError("pieces of this model reach over chunk borders")
    return m


def chunks(text: str) -> list[str]:
    """The text's chunks after normalisation, with ' ' for the blank mark; the dummy prefix is included."""
    return CHUNK.findall(" " + text.replace(SPACE, " ")) if text else []
