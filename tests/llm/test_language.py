from __future__ import annotations

import itertools
import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quatrain.llm import language
from quatrain.llm.queries import model_path

pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def pieces():
    return language.pieces_of(model_path())


def segmentations(pieces, word):
    """All ways to cut a word into pieces, by trying all sets of borders; a sign that is no piece stands as its bytes."""
    marked = "▁" + word
    for cuts in itertools.product((False, True), repeat=len(marked) - 1):
        parts, begin = [], 0
        for k in range(1, len(marked) + 1):
            if k == len(marked) or cuts[k - 1]:
                parts.append(marked[begin:k])
                begin = k
        if all(p in pieces.ids or len(p) == 1 for p in parts):
            yield [i for p in parts for i in ([pieces.ids[p]] if p in pieces.ids else [pieces.bytes[b] for b in p.encode()])]


WORDS = ["a", "the", "straße", "łódź", "señor", "日本", "ⴰⵣⵓⵍ", "xꙮy", "tionings", "eauouon"]


def test_sums_over_all_segmentations(pieces):
    log_p = np.log(np.random.default_rng(1).dirichlet(np.ones(pieces.size), 3).T)
    counts = np.arange(1.0, 1 + 3 * len(WORDS)).reshape(-1, 3)
    want = np.zeros((len(WORDS), 3))
    uses = np.zeros((pieces.size, 3))
    for w, word in enumerate(WORDS):
        found = list(segmentations(pieces, word))
        weights = np.array([np.exp(log_p[s].sum(0)) for s in found])
        want[w] = np.log(weights.sum(0))
        for s, x in zip(found, weights / weights.sum(0)):
            for i in s:
                uses[i] += x * counts[w]
    assert np.allclose(language.word_log_probabilities(pieces, WORDS, log_p), want, rtol=1e-12)
    got = language.expected_uses(pieces, WORDS, counts, log_p)
    assert np.abs(got / language.UNIT - uses).max() < 0.01
    # lattices with logarithms give the same where products are used
    lattices = language.Lattices(pieces, WORDS)
    assert np.allclose(lattices.totals(lattices.forward(log_p)), want, rtol=1e-12)
    assert np.abs(lattices.expected(log_p, counts, pieces.size) / language.UNIT - uses).max() < 0.01


def test_long_words_do_not_vanish(pieces):
    log_p = np.full((pieces.size, 2), -18.0)
    long = ["e" * n for n in (24, 25, 200, 256)]
    got = language.word_log_probabilities(pieces, long, log_p)
    assert np.isfinite(got).all() and (np.diff(got[:, 0]) < 0).all()
    words = language.words_of("É" * 600 + " x² 3d_e ٣ʼn")
    assert [len(w) for w in words[:3]] == [256, 256, 88] and words[3:6] == ["x", "d", "e"]


def test_parts_are_the_words(pieces):
    rnd = random.Random(4)
    signs = "abzAZÉß'’-_ 1²٣\n日本語łⅧ́"
    for _ in range(300):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 40)))
        parts = text.lower().encode().translate(language._BLANK).split()
        assert [w for p in parts for w in language.words_of(p.decode())] == language.words_of(text)


def sentences(rnd, words, n):
    return " ".join(rnd.choice(words) for _ in range(n)).capitalize() + "."


ENGLISH = "the of and to in is that for it with as was on are this be by not have from which river mountain window".split()
GERMAN = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch fluss berg fenster".split()


def labelled(rnd):
    rows = [(i, sentences(rnd, ENGLISH if i % 2 else GERMAN, rnd.randint(4, 30)), "en" if i % 2 else "de") for i in range(400)]
    return rows + [(500, None, "en"), (501, "", "de"), (502, "12 345 --- ²", "en"), (None, "die und der ist nicht", None), (503, "the and of " * 9000, None), (504, "é" * 5000, None), rows[3], rows[3]]


def test_predictions_and_defined_results(spark):
    rows = labelled(random.Random(2))
    df = spark.createDataFrame([(*r, 1.0, "clash") for r in rows], "doc_id long, text string, lang string, score double, held_out string")
    got = language.identify_languages(df, model_path()).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, text, lang in rows:
        r = by_id[i]
        assert r["held_out"] == (zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        if i is not None and i < 400:
            assert r["lang_pred"] == lang
    assert [by_id[i]["lang_pred"] for i in (500, 501, 502)] == ["und"] * 3 and by_id[500]["score"] == 0.0
    assert by_id[None]["lang_pred"] == "de" and by_id[503]["lang_pred"] == "en" and by_id[504]["lang_pred"] in ("de", "en")
    # held-out texts and unlabelled rows teach nothing
    other = [(i, "zzz qqq" if i is not None and zlib.crc32(str(i).encode()) % 4 == 2 else t, lang) for i, t, lang in rows]
    again = {r["doc_id"]: r for r in language.identify_languages(spark.createDataFrame(other, "doc_id long, text string, lang string"), model_path()).collect()}
    for i, r in by_id.items():
        if not r["held_out"]:
            assert math.isclose(again[i]["score"], r["score"]) and again[i]["lang_pred"] == r["lang_pred"]
    assert language.identify_languages(df.limit(0), model_path()).count() == 0
    none = language.identify_languages(df.withColumn("lang", F.lit(None).cast("string")), model_path()).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}


def test_small_cache_gives_the_same(pieces):
    rnd = random.Random(3)
    log_p = np.log(np.random.default_rng(2).dirichlet(np.ones(pieces.size), 2).T)
    texts = [sentences(rnd, ENGLISH + GERMAN, 20) for _ in range(60)]
    args = (model_path(), ["de", "en"], np.log([0.5, 0.5]), log_p)
    small, large = language.Scorer(*args, cache_bytes=2_000), language.Scorer(*args)
    got = [small.predict(texts[i : i + 5]) for i in range(0, 60, 5)]
    names, scores = large.predict(texts)
    assert [n for g in got for n in g[0]] == names and np.allclose([x for g in got for x in g[1]], scores)
    assert small.held < 12_000


def test_sample_of_a_label_is_bounded(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "case when id % 10 = 0 then 'rare' else 'often' end as lang")
    n = {r["lang"]: r["count"] for r in language.sampled(df, {"rare": 2000, "often": 18_000}, "lang", "doc_id", 3000).groupBy("lang").count().collect()}
    assert n["rare"] == 2000 and 2800 < n["often"] < 3200


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_accuracy(spark):
    from quatrain.llm.queries import op11_language_unigrams

    out = op11_language_unigrams(spark, DATA)
    assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    rows = out.join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.99 * len(rows)
