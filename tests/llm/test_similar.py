from __future__ import annotations

import random

import pytest

import corpus_pipeline
from quatrain.llm import similar
from quatrain.llm.similar import similar_texts


def shingles(text: str | None) -> frozenset[str]:
    words = (text or "").split()
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows: list[tuple]) -> list:
    sets, least = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                least[root(i)] = root(j)
    ids: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)] = min(d, ids.get(root(i), d))
    return [ids.get(root(i)) for i in range(len(rows))]


def edited_copies() -> list[tuple]:
    rnd = random.Random(4)
    words, rows = [f"w{i}" for i in range(200)], []
    for size in [30, 60, 60, 100, 100, 300] * 4:
        base = [rnd.choice(words) for _ in range(size)]
        for _ in range(rnd.choice([2, 3, 12])):
            own = list(base)
            for _ in range(rnd.randint(0, max(1, size // 40))):
                own[rnd.randrange(size)] = f"edit{rnd.randrange(10_000)}"
            rows.append((100 + len(rows), " ".join(own)))
    rows += [(900, None), (901, ""), (902, "a b"), (903, "a b"), (904, "a b c d e f"), (905, "a b c d e"), (None, rows[0][1]), rows[3]]
    return rows


@pytest.mark.parametrize(("hot", "block", "visits"), [(20_000, 256, 8), (20_000, 3, 8), (20_000, 3, 0), (5, 4, 8), (1, 3, 0)])
def test_recall_is_whole(spark, monkeypatch, hot, block, visits):
    """Every link at 0.8 is found on these rows, in one block and in many, by fingerprints and by the exact way."""
    monkeypatch.setattr(similar, "VISITS", visits)
    rows = edited_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in similar_texts(df, hot_bucket=hot, block=block).collect())
    assert got == sorted((str(d), str(c)) for (d, _), c in zip(rows, brute(rows)))
    assert similar_texts(df.limit(0)).count() == 0


def test_overlaps():
    rnd = random.Random(2)
    sets = [similar.np.unique(similar.np.array([rnd.randrange(60) for _ in range(n)], similar.np.uint64)) for n in (0, 1, 5, 20, 30, 40, 50)]
    found = similar.overlaps(sets[:4], sets)
    assert found.tolist() == [[len(set(x) & set(y)) for y in sets] for x in sets[:4]]
    square = similar.overlaps(sets, sets)
    assert all(square[i, j] == len(set(x) & set(y)) for i, x in enumerate(sets) for j, y in enumerate(sets) if i != j)


def test_stage_keeps_one_of_edited_copies(spark):
    rows = edited_copies()
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect())
    assert got == sorted({c for (d, _), c in zip(rows, brute(rows)) if d == c})


def test_very_long_texts(spark):
    rnd = random.Random(12)
    long = [f"w{rnd.randrange(5000)}" for _ in range(60_000)]
    near = [w if rnd.random() > 0.01 else "edit" for w in long]
    far = [w if rnd.random() > 0.2 else "edit" for w in long]
    rows = [(3, " ".join(long)), (2, " ".join(near)), (1, " ".join(far))]
    got = {r["doc_id"]: r["component_id"] for r in similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 2}


def chains() -> list[tuple]:
    """Texts of which each is near to the next only: a chain holds together by its links alone."""
    rnd = random.Random(5)
    rows = []
    for size in (100, 250):
        own = [f"c{rnd.randrange(400)}" for _ in range(size)]
        for step in range(12):
            rows.append((len(rows), " ".join(own)))
            for k in range(size // 70 + 1):
                own[(step * 7 + k * 31) % size] = f"turn{step}x{k}"
    return rows


@pytest.mark.parametrize("hot", [1, 5, 20_000])
def test_chains_hold_together(spark, hot):
    rows = chains()
    rnd = random.Random(6)
    rnd.shuffle(rows)
    want = brute(rows)
    # the ends of a chain are far apart
    assert len(set(want)) == 2
    got = {r["doc_id"]: r["component_id"] for r in similar_texts(spark.createDataFrame(rows, "doc_id long, text string"), hot_bucket=hot).collect()}
    assert [got[d] for d, _ in rows] == want


def pairs_by_band(rnd) -> list[tuple[float, str, str]]:
    """(similarity, text, edited text), several hundred a band of 0.05."""
    out = []
    for _ in range(2600):
        size = rnd.choice([60, 120, 250, 500])
        base = [f"w{rnd.randrange(3000)}" for _ in range(size)]
        own = list(base)
        for _ in range(rnd.randint(0, max(1, size // 45))):
            own[rnd.randrange(size)] = f"e{rnd.randrange(10**6)}"
        a, b = shingles(" ".join(base)), shingles(" ".join(own))
        out.append((len(a & b) / len(a | b), " ".join(base), " ".join(own)))
    return out


def test_recall_of_keys_by_band():
    """Pairs whose fingerprints share a key and are near enough to be compared, of all pairs at a similarity."""
    from quatrain.llm.golay import fuzzy_keys, golay_tables

    tables, found = golay_tables(), {}
    for alike, a, b in pairs_by_band(random.Random(9)):
        words = [similar.np.frombuffer(similar.word_fingerprint(similar.words_of(t)), ">i8").astype(similar.np.int64) for t in (a, b)]
        keys = [set(fuzzy_keys([w[:1], w[1:]], tables)[0].tolist()) for w in words]
        apart = int(similar.np.bitwise_count((words[0] ^ words[1]).view(similar.np.uint64)).sum())
        if alike >= 0.8:
            found.setdefault(min(19, int(alike * 20 + 1e-9)), []).append(bool(keys[0] & keys[1]) and apart <= similar.ERRORS)
    assert set(found) == {16, 17, 18, 19} and all(len(x) >= 100 for x in found.values())
    for band, met in found.items():
        assert sum(met) >= 0.9 * len(met), (band / 20, sum(met) / len(met))
