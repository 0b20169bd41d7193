from __future__ import annotations

import hashlib
import random

import pytest

from quatrain.llm import pfp


def brute(texts: list[bytes]) -> list[tuple[int, int, int, str]]:
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - pfp.LENGTH + 1):
            s = t[i : i + pfp.LENGTH]
            seen[s] = seen.get(s, 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - pfp.LENGTH + 1):
            if seen[t[i : i + pfp.LENGTH]] > 1:
                gone[i : i + pfp.LENGTH] = b"\1" * pfp.LENGTH
        rest = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return out


def texts_with_repeats(rnd: random.Random, n: int) -> list[str]:
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7))) for _ in range(400)]
    prose = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    shared = [prose(rnd.randint(20, 120)) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [prose(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):
            s = rnd.choice(shared)
            a = rnd.randint(0, len(s) // 2)
            s = s[a : rnd.randint(a, len(s))]
            if rnd.random() < 0.3 and s:
                at = rnd.randrange(len(s))
                s = s[:at] + "#" + s[at + 1 :]
            parts += [s, prose(rnd.randint(0, 30))]
        out.append(rnd.choice(["", " "]).join(parts))
    out += [out[3], out[3], "x" * 5000, "x" * 199, "y" * 200, "ab" * 700, "", "z" * 230 + prose(20)]
    base = "-".join(f"{rnd.random()}" for _ in range(12))
    out += [base[:200], base[:200], base[:199], base[1:200], base[5:205] + "!", "?" + base[6:207]]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    texts = texts_with_repeats(random.Random(seed), 60)
    rows = [(i, t, 0, "c") for i, t in enumerate(texts)] + [(900, None, 0, "c"), (None, texts[0], 0, "c"), (5, texts[5], 0, "c"), (5, texts[6], 0, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id int, body string")
    got = sorted((tuple(r) for r in pfp.remove_repeats(df).collect()), key=str)
    want = brute([(r[1] or "").encode() for r in rows])
    assert got == sorted(((r[0], *w) for r, w in zip(rows, want)), key=str)
    assert sum(w[1] > 0 for w in want) > 20


def test_kept_bytes_and_empty(spark):
    text = "".join(f"{i * i} " for i in range(100))
    df = spark.createDataFrame([(1, "head " + text), (2, text + "tail"), (3, "own")], "doc_id long, text string")
    kept = {r["doc_id"]: bytes(r["kept"]) for r in pfp.remove_repeats(df, with_kept=True).collect()}
    assert kept == {1: b"head ", 2: b"tail", 3: b"own"}
    assert pfp.remove_repeats(df.limit(0)).count() == 0


def test_hot_triggers_go_by_single_strings(spark):
    texts = texts_with_repeats(random.Random(3), 40)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in pfp.remove_repeats(df, hot=2).collect())
    assert got == [(i, *w) for i, w in enumerate(brute([t.encode() for t in texts]))]


def test_very_long_texts_in_pieces(spark, monkeypatch):
    rnd = random.Random(5)
    words = [f"{rnd.random():.6f}"[2:] for _ in range(4000)]
    prose = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    long, shared = prose(50_000), prose(60)
    texts = [long[:200_000] + shared + long[200_000:], shared + prose(400), long[150_000:] + "\0" + prose(200), "a\0" * 150 + "b", "a\0" * 150 + "\0"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in pfp.remove_repeats(df).collect())
    assert got == [(i, *w) for i, w in enumerate(brute([t.encode() for t in texts]))]


def test_repeated_rows_do_not_grow(spark):
    """Entries follow the distinct texts, however often a row is repeated."""
    texts = texts_with_repeats(random.Random(7), 20)
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, texts[4])] * 30 + [(101 + k, texts[4] + f" end {k}") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in pfp.remove_repeats(df).collect()), key=str)
    assert got == sorted(((r[0], *w) for r, w in zip(rows, brute([t.encode() for _, t in rows]))), key=str)
    # entries of distinct texts: one a trigger, so about 2 / OFFSETS a byte of texts that do not repeat themselves
    bodies = [t.encode() for t in {t for _, t in rows if len(t.encode()) >= pfp.LENGTH and len(set(t)) > 3}]
    batch = pfp.pa.RecordBatch.from_arrays([pfp.pa.array(range(len(bodies)), pfp.pa.int64()), pfp.pa.array([0] * len(bodies), pfp.pa.int32()), pfp.pa.array(bodies, pfp.pa.binary())], names=["rid", "rid2", "body"])
    entries = sum(b.num_rows for b in pfp._parse([batch]))
    assert entries <= len(bodies) + 4 * sum(map(len, bodies)) / pfp.OFFSETS


def test_one_batch_stays_small():
    """What the parser holds at a time is bounded by PIECE, not by the text."""
    parts = list(pfp.pieces([10 * pfp.PIECE, 300, 300]))
    assert max(sum(b - a for _, a, b in p) for p in parts) <= pfp.PIECE
    starts = {s for p in parts for i, a, b in p if i == 0 for s in (a, b - pfp.LENGTH)}
    assert 0 in starts and 10 * pfp.PIECE - pfp.LENGTH in starts
