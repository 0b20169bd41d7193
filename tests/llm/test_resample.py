from __future__ import annotations

import glob
import hashlib
import math
import os
import re
import zlib

import pytest

from quatrain.llm import resample

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows, target, longest=1, least=20, share=(10, 100), seed=2024, buckets=10_000):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")

    def features(t):
        w = WORD.findall(lower(t))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    docs = [(d, *features(t)) for d, t in rows]
    s, t = [0] * buckets, [0] * buckets
    for _, _, f in docs:
        for b in f:
            s[b] += 1
    for text in target:
        for b in features(text)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t)]
    out = []
    for d, n, f in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    may = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for k, r in enumerate(may[: share[0] * len(may) // share[1]], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


def rows_of(spark):
    made = [(i, " ".join(f"w{(i * 7 + k * k) % 90}É Über-{k % 5}" for k in range(i % 60))) for i in range(150)]
    made += [(900, None), (901, ""), (902, " \t.,;"), (None, "word " * 30), (903, "Long tail " * 5_000), (3, made[40][1]), (3, made[40][1]), (904, "日本語 x" * 30)]
    return made, spark.createDataFrame([(*r, "clash", 1) for r in made], "doc_id long, text string, score string, rank int")


@pytest.mark.parametrize("longest, chunk_words", [(1, 8192), (1, 7), (3, 5), (2, 1)])
def test_against_brute_force(spark, longest, chunk_words):
    rows, df = rows_of(spark)
    target = ["w1É Über-2 w5É", None, "", "tail tail long"]
    got = resample.importance_resample(df, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, chunk_words=chunk_words)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, target, longest)


def test_empty_tables(spark):
    _, df = rows_of(spark)
    none = spark.createDataFrame([], "text string")
    assert resample.importance_resample(df.limit(0), none).count() == 0
    assert resample.importance_resample(df, none).count() == 158


def test_chunks_own_every_start_once():
    words = [f"w{i}" for i in range(23)]
    for size in (1, 4, 23, 50):
        parts = list(resample.chunks_of(" ".join(words), 3, size))
        assert sum(own for _, own in parts) == 23
        runs = [tuple(c[i : i + n]) for c, own in parts for n in (1, 2, 3) for i in range(own) if i + n <= len(c)]
        assert sorted(runs) == sorted(tuple(x.encode() for x in words[i : i + n]) for n in (1, 2, 3) for i in range(24 - n))
    assert list(resample.chunks_of("", 1, 4)) == [([], 0)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_query_equals_its_sql(spark):
    import duckdb

    from quatrain.llm.queries import op13_importance_resampling

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got = op13_importance_resampling(spark, DATA)
    want = con.execute(resample.RESAMPLE_SQL)
    assert [c[0] for c in want.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    assert dict(got.dtypes) == dict.fromkeys(got.columns, "bigint")
