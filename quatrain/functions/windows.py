"""Sets of terms by their lengths: all terms in many texts at once, by hashed windows that the terms' signs prove."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Stands between texts: no sign has it, so no term reaches over it.
BETWEEN = 0x110000
#: Places that are looked at together.
PLACES = 1 << 18
BASE, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def signs_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, with BETWEEN behind each, and where each text begins."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + 1)
    signs = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), np.uint32).copy() if texts else np.zeros(0, np.uint32)
    signs[ends - 1] = BETWEEN
    return signs, ends - sizes - 1


def _mixed(signs: np.ndarray) -> np.ndarray:
    x = signs.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    return x * np.uint64(0x94D049BB133111EB)


class Windows:
    """Distinct terms that are not empty, under their numbers. Of each length the terms' hashes are sorted, with their signs
    beside them: a window whose hash is there is a hit if its signs are the term's as well. That takes 4 bytes a sign and
    some 20 a term, and time that grows with the texts and with the number of lengths, not with that of the terms."""

    def __init__(self, terms: pa.Array):
        parts = [signs_of(terms.slice(at, PLACES).to_pylist()) for at in range(0, len(terms), PLACES)]
        base = BASE
        while not self._built(parts, base):
            base = (base * BASE + 2) & MASK

    def _built(self, parts: list[tuple[np.ndarray, np.ndarray]], base: int) -> bool:
        """False if two terms share a hash."""
        found: dict[int, list] = {}
        number = 0
        for signs, begins in parts:
            sizes = np.diff(np.append(begins, len(signs))) - 1
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                found.setdefault(size, []).append((signs[begins[own][:, None] + np.arange(size)], (own + number).astype(np.int32)))
            number += len(begins)
        self.base, self.tables = base, []
        powers = self._powers(base, max(found, default=0))
        for size in sorted(found):
            shapes, numbers = (np.concatenate(x) for x in zip(*found[size], strict=True))
            hashes = np.zeros(len(shapes), np.uint64)
            for k in range(size):
                hashes += _mixed(shapes[:, k]) * powers[k]
            order = np.argsort(hashes)
            hashes = hashes[order]
            if (hashes[1:] == hashes[:-1]).any():
                return False
            self.tables.append((size, hashes, shapes[order], numbers[order]))
        self._ready = None
        return True

    def __getstate__(self):
        return self.base, self.tables

    def __setstate__(self, state):
        self.base, self.tables = state
        self._ready = None

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n + 1, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    @property
    def sizes(self) -> list[int]:
        return [t[0] for t in self.tables]

    def _helpers(self):
        if self._ready is None:
            marks = []
            for _, hashes, _, _ in self.tables:
                # eight places a term, so that most windows fail by one look
                shift = np.uint64(64 - min(24, max(10, (8 * len(hashes)).bit_length())))
                held = np.zeros(1 << (64 - int(shift)), bool)
                held[(hashes * np.uint64(BASE)) >> shift] = True
                marks.append((shift, held))
            n = PLACES + max(self.sizes, default=0)
            self._ready = marks, self._powers(self.base, n), self._powers(pow(self.base, -1, 1 << 64), n)
        return self._ready

    def every(self, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, number) of every occurrence of every term, by start and then from long to short."""
        marks, powers, inverse = self._helpers()
        most, out = max(self.sizes, default=0), []
        for at in range(0, len(signs), PLACES):
            part = signs[at : at + PLACES + most]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_mixed(part) * powers[: len(part)], out=sums[1:])
            for (size, hashes, shapes, numbers), (shift, held) in zip(self.tables, marks, strict=True):
                n = min(len(part) - size + 1, PLACES)
                if n <= 0:
                    continue
                own = (sums[size : size + n] - sums[:n]) * inverse[:n]
                place = np.flatnonzero(held[(own * np.uint64(BASE)) >> shift])
                own = own[place]
                term = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                same = hashes[term] == own
                place, term = place[same], term[same]
                for k in range(size):
                    same = part[place + k] == shapes[term, k]
                    if not same.all():
                        place, term = place[same], term[same]
                out.append((place + at, np.full(len(place), size, np.int64), numbers[term]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        start, sizes, number = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((-sizes, start))
        return start[order], sizes[order], number[order]

    def uncovered(self, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of the occurrences that no longer occurrence covers: none that stands ahead in this order ends as late."""
        start, sizes, number = self.every(signs)
        if len(start):
            ends = start + sizes
            kept = np.append(True, ends[1:] > np.maximum.accumulate(ends)[:-1])
            start, sizes, number = start[kept], sizes[kept], number[kept]
        return start, sizes, number
