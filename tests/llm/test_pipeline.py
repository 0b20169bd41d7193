from __future__ import annotations

import os
import random
import sys

sys.path.insert(0, os.path.dirname(__file__))

from test_decontaminate import brute_edits
from test_line_dedup import brute as brute_lines
from test_quality import brute_kept, fixture
from test_similar import brute as brute_similar

import corpus_pipeline
from quatrain.llm import decontaminate, line_dedup
from quatrain.llm.queries import ORACLE_SQL, QUERIES, model_path

ITEMS = [(1, "the quick brown fox jumps over the lazy dog near the river bank"), (2, None), (3, "two words")]


def documents() -> list[tuple]:
    rnd = random.Random(12)
    rows = [(d, t, la, so, len(t) if t else None) for d, t, la, so, *_ in fixture(3)[:420]]
    long = [r for r in rows if len((r[1] or "").split()) >= 80]
    for k, (_, t, la, so, _) in enumerate(rnd.sample(long, 12)):
        words = t.split(" ")
        words[rnd.randrange(len(words))] = "edited"
        rows.append((600 + k, " ".join(words), la, so, 1))
        rows.append((700 + k, t + "\n" + ITEMS[0][1].replace("lazy", "sleepy"), la, so, 1))
    sites = ["a", "b", "c", "d", "e", "f", "g", "h", "i"]
    for k in range(40):
        d, t, la, _, n = rnd.choice(long)
        rows.append((800 + k, f"{k} {t[::-1]}\nfollow us on all of our channels", la, sites[k % 9], n))
    rows += [(None, rows[10][1], "en", "a", 1), rows[30], rows[30], (999, None, None, None, None)]
    return rows


def brute(rows: list[tuple]) -> list[tuple]:
    import sentencepiece

    rows = [r for r, k in zip(rows, brute_kept([(r[1], r[2], r[3]) for r in rows])) if k]
    before = brute_lines([(r[0], r[1], r[3]) for r in rows], line_dedup.MIN_SITES)
    cut = {}
    for r in rows:
        options = [t for d, t, *_ in before if d == r[0]]
        cut[r[0], r[1]] = next(t for t in options if t == r[1] or set(t.split("\n")) <= set(r[1].split("\n")))
    rows = [(r[0], cut[r[0], r[1]], r[2], r[3]) for r in rows]
    named = brute_similar([(r[0], r[1]) for r in rows])
    rows = sorted({r for i, r in enumerate(rows) if r[0] == named[i]}, key=str)
    item = decontaminate.words_of(ITEMS[0][1])
    rows = [r for r in rows if brute_edits(item, decontaminate.words_of(r[1])) > int(decontaminate.MOST_EDITS * len(item))]
    lib = sentencepiece.SentencePieceProcessor(model_file=model_path())
    return sorted(((d, la, so, lib.encode(t), t) for d, t, la, so in rows), key=str)


def test_against_brute_force(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = documents()
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)
    want = brute(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert got == want
    kept = {g[0] for g in got}
    assert len(kept) > 60 and not kept & set(range(700, 712)) and len(kept & set(range(600, 612))) < 12
    assert sum("follow us" in g[4] for g in got) <= 1


def test_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES) and len(corpus_pipeline.STAGES) == 5
