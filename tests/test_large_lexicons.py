from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quatrain.operators import lexicon
from quatrain.plans.wide import lexicon_of_talks


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_occurrences_are_found_without_sorting_matches(spark):
    words = spark.createDataFrame([("a", 0, "ab"), ("a", 0, "b"), ("c", 1, "cd"), ("d", 2, "ab")], "category string, cat_pos int, term string")
    docs = spark.createDataFrame([(1, "cdxb ab ab b"), (2, "zz"), (1, "b")], "id int, text string")
    found = lexicon.category_terms(lexicon.find_matches(docs, words))
    assert "SortAggregate" not in plan_of(found)
    assert sorted((r["id"], r["category"], r["terms"]) for r in found.collect()) == [(1, "a", ["b", "ab"]), (1, "c", ["cd"]), (1, "d", ["ab"])]


def test_a_lexicon_of_two_million_signs_reads_texts_once(spark):
    words = spark.range(250_000).selectExpr("'c' AS category", "0 AS cat_pos", "lpad(id, 8, 'x') AS term")
    docs = spark.createDataFrame([(7, "xx249999xx\nx00017xxx00017")], "id int, text string")
    found = lexicon.find_matches(docs, words)
    assert plan_of(found).count("MapInArrow") == 1
    assert sorted((r["term"], r["start"]) for r in found.collect()) == [("xx249999", 0)]


def test_no_match_is_shuffled(spark, tmp_path):
    spark.createDataFrame([(1, "thin ice\nthinner"), (2, None), (3, "ice")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("user", "thin ice thinner"), ("system", "thin"), (None, "thin\tmore")], "role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = lexicon_of_talks(spark, str(tmp_path))
    assert "Exchange" not in plan_of(found)
    assert sorted(map(tuple, found.collect()), key=str) == [(1, "system", 1, 1, 0), (1, "user", 2, 2, 0), (1, None, 1, 1, 0)]


def test_covered_matches_of_other_blocks_go_where_the_text_is_read(spark):
    words = spark.createDataFrame([("c", 0, "a" * n + "b") for n in range(1, 9)], "category string, cat_pos int, term string")
    docs = spark.createDataFrame([(1, "aaab"), (1, "aaab ab"), (None, "b")], "id int, text string")
    found = lexicon.find_matches(docs, words, block_signs=6)
    assert "Exchange" not in plan_of(found)
    assert sorted((r["id"], r["term"], r["start"]) for r in found.collect()) == [(1, "aaab", 0), (1, "aaab", 0), (1, "ab", 5)]


@pytest.mark.parametrize("signs", [1_000_000, 40])
@pytest.mark.parametrize("ids", [70, 1000])
def test_counts_are_those_of_all_matches(spark, signs, ids):
    rnd = random.Random(ids + signs)
    terms = sorted({"".join(rnd.choice("abc月") for _ in range(rnd.randint(1, 7))) for _ in range(60)} | {"𠀀a"})
    rows = [(f"c{i % 5}" if i % 5 else None, i % 3 or None, t) for i, t in enumerate(terms)] + [("more", 9, terms[0])] * 2
    words = spark.createDataFrame(rows, "category string, cat_pos int, term string")
    texts = ["".join(rnd.choice("abc月\n.𠀀") for _ in range(rnd.randint(0, 60))) for _ in range(80)] + [None, "", terms[0], terms[0]]
    docs = spark.createDataFrame([(i % ids or None, t) for i, t in enumerate(texts)], "id int, text string")
    want = lexicon.find_matches(docs, words).groupBy("id", "category", "cat_pos").agg(F.count("*"), F.count_distinct("term"), F.min("start"))
    got = lexicon.count_matches(docs, words, block_signs=signs)
    assert got.columns == ["id", "category", "cat_pos", "n", "n_terms", "first_start"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) != []
