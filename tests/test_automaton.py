from __future__ import annotations

import pickle
import random
import time

import pytest
from pyspark.sql import functions as F

from quatrain.functions.automaton import Automaton
from quatrain.operators import lexicon


def brute(terms, text):
    hits = {(s, s + len(t)) for t in terms if t for s in range(len(text)) if text.startswith(t, s)}
    kept = [h for h in hits if not any(o != h and o[0] <= h[0] and h[1] <= o[1] for o in hits)]
    return sorted(hits, key=lambda h: (h[1], h[0])), sorted(kept)


@pytest.mark.parametrize("seed", range(6))
def test_every_occurrence(seed):
    rnd = random.Random(seed)
    signs = "ab" if seed % 2 else "abc月𠀀"
    terms = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 7))) for _ in range(rnd.randint(0, 40))]
    machine = pickle.loads(pickle.dumps(Automaton(terms)))
    for _ in range(60):
        text = "".join(rnd.choice(signs + "x") for _ in range(rnd.randint(0, 50)))
        every, uncovered = brute(terms, text)
        assert list(machine.every(text)) == every and machine.uncovered(text) == uncovered


def test_time_follows_the_text_and_not_the_terms():
    """The worst text for trying terms at each place: each place is nearly a term."""
    machine = Automaton(["a" * n for n in range(1, 400)] + ["a" * 400 + "b"])
    took = []
    for n in (50_000, 200_000):
        begin = time.process_time()
        found = machine.uncovered("a" * n)
        took.append(time.process_time() - begin)
        assert len(found) == n - 398
    assert took[1] < 12 * took[0]


def test_a_lexicon_of_100_000_terms(spark):
    rnd = random.Random(8)
    terms = list({"".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 9))) for _ in range(130_000)})[:100_000]
    texts = ["".join(rnd.choice("abcdefgh \n") for _ in range(rnd.randint(0, 400))) for _ in range(60)]
    known, sizes, want = set(terms), range(3, 10), []
    for i, text in enumerate(texts):
        flat = text.replace("\n", "")
        hits = [(s, s + n) for s in range(len(flat)) for n in sizes if s + n <= len(flat) and flat[s : s + n] in known]
        want += [(i, flat[a:b], a, b) for a, b in hits if not any(o != (a, b) and o[0] <= a and b <= o[1] for o in hits)]
    words = spark.createDataFrame([("c", 0, t) for t in terms], "category string, cat_pos int, term string")
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for signs in (lexicon.BLOCK_SIGNS, 250_000):
        found = lexicon.find_matches(docs, words, block_signs=signs).select("id", "term", "start", "end")
        assert sorted(map(tuple, found.collect())) == sorted(want)
    assert lexicon.find_matches(docs.withColumn("text", F.lit(None).cast("string")), words).count() == 0
