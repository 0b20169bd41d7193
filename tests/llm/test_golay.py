from __future__ import annotations

import random

import numpy as np
import pytest

from quatrain.llm import golay


def brute_components(fps: list[int], ids: list[int | None]) -> dict[int, int | None]:
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    least: dict = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return {i: least.get(root(i)) for i in range(len(fps))}


def test_code_is_perfect():
    rest, errors = golay.golay_tables()
    counts = (errors >= 0).sum(axis=1)
    assert set(counts) == {1, 6} and (counts == 6).sum() == 1771
    words = np.arange(1 << 23, dtype=np.int64)[:: 4099]
    e = errors[(words & 2047) ^ rest[words >> 11]]
    code = np.where(e < 0, 0, words[:, None] ^ e)
    assert ((code & 2047) == rest[code >> 11]).all()


def test_keys_meet_within_four_bits():
    rnd, tables = random.Random(5), golay.golay_tables()
    for _ in range(300):
        x = rnd.getrandbits(64)
        y = x
        for bit in rnd.sample(range(64), rnd.randint(0, 4)):
            y ^= 1 << bit
        both = np.array([x, y], np.uint64).view(np.int64)
        keys, owners = golay.fuzzy_keys([both], tables)
        assert set(keys[owners == 0]) & set(keys[owners == 1])


def fingerprint_by_words(text: str) -> str:
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return f"{sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)):016x}"


TEXTS = ["", " \n\t", "one", "One TWO", "a b c d", "É a\x0bb c É d e\x85f", "x " * 9000, "Der Die das und der die das"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert golay.fingerprint(text).hex() == fingerprint_by_words(text)


@pytest.mark.parametrize("hot", [20_000, 3])
def test_components(spark, hot):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(40):
        base = [rnd.choice(words) for _ in range(60)]
        for _ in range(rnd.randint(1, 6)):
            own = list(base)
            for _ in range(rnd.randint(0, 3)):
                own[rnd.randrange(60)] = "edit"
            texts.append(" ".join(own))
    texts += [None, "", "", "same text here now", "same text here now"]
    ids = list(range(100, 100 + len(texts) - 1)) + [None]
    rows = [(d, t, "x", "y", "z") for d, t in zip(ids, texts)] + [(100, texts[0], "x", "y", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, key string, component_id string")
    got = golay.near_duplicates(df, hot_bucket=hot).collect()
    ids, texts = [r[0] for r in rows], [r[1] or "" for r in rows]
    want = brute_components([int(fingerprint_by_words(t), 16) for t in texts], ids)
    expected = sorted((str(d), fingerprint_by_words(t), str(want[i])) for i, (d, t) in enumerate(zip(ids, texts)))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == expected
    assert golay.near_duplicates(df.limit(0)).count() == 0
