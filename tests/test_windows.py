from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quatrain.functions.windows import Windows, signs_of
from quatrain.operators import words


def brute(terms, text):
    hits = {(s, s + len(t)) for t in terms for s in range(len(text)) if text.startswith(t, s)}
    return sorted(hits, key=lambda h: (h[0], -h[1])), sorted(h for h in hits if not any(o != h and o[0] <= h[0] and h[1] <= o[1] for o in hits))


@pytest.mark.parametrize("places", [7, 1 << 18])
def test_windows_against_brute_force(monkeypatch, places):
    monkeypatch.setattr("quatrain.functions.windows.PLACES", places)
    rnd = random.Random(places)
    for signs in ("ab", "abc月𠀀\n"):
        terms = list({"".join(rnd.choice(signs) for _ in range(rnd.randint(1, 9))) for _ in range(40)})
        texts = ["".join(rnd.choice(signs + "x") for _ in range(rnd.randint(0, 60))) for _ in range(40)]
        flat, begins = signs_of(texts)
        machine = Windows(pa.array(terms))
        for found, k in ((machine.every(flat), 0), (machine.uncovered(flat), 1)):
            text = np.searchsorted(begins, found[0], "right") - 1
            for i, t in enumerate(texts):
                own = [(s - begins[i], s - begins[i] + n) for s, n, j in zip(*found) if text[np.flatnonzero(found[0] == s)[0]] == i]
                assert own == brute(terms, t)[k]
            assert all(terms[j] == "".join(map(chr, flat[s : s + n])) for s, n, j in zip(*found))
    assert [len(x) for x in Windows(pa.array([], pa.string())).every(flat)] == [0, 0, 0]


def test_memory_of_words_does_not_follow_the_rows_of_a_batch():
    rnd = random.Random(1)
    known = ["".join(rnd.choice("abcdef") for _ in range(rnd.randint(2, 5))) for _ in range(300)]
    rows = pa.table({"word": list(dict.fromkeys(known)), "weight": [-5_000_000] * len(set(known)), "tag": ["w"] * len(set(known))})
    held = type("Held", (), {"value": words._Known(rows, ["w"])})
    took = []
    for n in (1_000, 8_000):
        lines = [["".join(rnd.choices("abcdef", k=500))] for _ in range(n)]
        batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(lines, pa.list_(pa.string())), pa.array([None] * n, pa.binary())], names=["i", "__lines", "__arcs"])
        tracemalloc.start()
        assert sum(part.num_rows for part in words._cut(held, -9_000_000, ["w"])([batch])) == n
        took.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert took[1] < 2 * took[0]
