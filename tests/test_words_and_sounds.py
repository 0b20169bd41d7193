from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from quatrain.operators import scoring as S
from quatrain.operators.pronounce import with_sounds
from quatrain.operators.words import UNIT, with_tags, with_words


def weights_of(dictionary):
    freq = {}
    for w, f, *_ in dictionary:
        if w:
            freq[w] = max(f, freq.get(w, 0))
    total = math.floor(UNIT * math.log(sum(freq.values()))) if freq else 0
    return {w: math.floor(UNIT * math.log(f)) - total for w, f in freq.items()}, -total


def best_of_all(line, dictionary):
    """The highest sum over all ways to cut the line; the cut that is longest from its end where sums tie."""
    known, unknown = weights_of(dictionary)
    best = None
    for borders in itertools.product((0, 1), repeat=max(0, len(line) - 1)):
        cuts = [0, *(i + 1 for i, b in enumerate(borders) if b), len(line)]
        words = [line[a:b] for a, b in zip(cuts, cuts[1:])] if line else []
        if all(len(w) == 1 or w in known for w in words):
            key = (sum(known.get(w, unknown) for w in words), [len(w) for w in reversed(words)])
            best = max(best or (key, words), (key, words))
    return best[0][0], best[1]


@pytest.mark.parametrize("block_signs", [1_000_000, 12])
def test_words_against_all_cuts(spark, block_signs):
    rnd = random.Random(3)
    dictionary = list({"".join(rnd.choice("abc月") for _ in range(rnd.randint(1, 4))): rnd.choice([1, 2, 2, 5, 40]) for _ in range(30)}.items())
    dictionary += [(dictionary[0][0], 1), ("", 3)]
    lines = ["".join(rnd.choice("abc月z") for _ in range(rnd.randint(0, 11))) for _ in range(120)]
    words = spark.createDataFrame([(w, f, f"t{len(w)}" if len(w) < 4 else None) for w, f in dictionary], "word string, freq int, tag string")
    df = spark.createDataFrame([(i, lines[i : i + 3], "clash", 7) for i in range(0, 120, 3)] + [(900, None, "", 1), (901, [], "", 1)], "i int, lines array<string>, word string, weight int")
    rows = {r["i"]: r["words"] for r in with_words(df, words, F.col("lines"), block_signs=block_signs).collect()}
    assert rows[900] is None and rows[901] == []
    for i in range(0, 120, 3):
        for line, cut in zip(lines[i : i + 3], rows[i]):
            assert (cut["weight"], [w["word"] for w in cut["words"]]) == best_of_all(line, dictionary)
            known = {w for w, _ in dictionary}
            assert all(w["tag"] == ("x" if w["word"] not in known or len(w["word"]) == 4 else f"t{len(w['word'])}") for w in cut["words"])
    none = with_words(df, words.limit(0), F.col("lines")).where("i = 0").first()["words"]
    assert [[w["word"] for w in line["words"]] for line in none] == [list(x) for x in lines[:3]]


def test_the_likelier_word_wins_over_the_longer(spark):
    words = spark.createDataFrame([("研究", 50, "v"), ("研究生", 2, "n"), ("生命", 60, "n"), ("起源", 20, "n"), ("命", 1, "n")], "word string, freq int, tag string")
    df = spark.createDataFrame([("研究，生命起源",)], "text string")
    cut = with_words(df, words, F.array(F.replace("text", F.lit("，"), F.lit("")))).first()["words"][0]
    assert [w["word"] for w in cut["words"]] == ["研究", "生命", "起源"]
    assert with_tags(df, words).first()["tags"] == [["v", "n", "n"]]


SOUND = "phrase string, final string, tone int, syllable string"


def test_phrases_before_single_signs(spark):
    table = spark.createDataFrame([("还", "uan", 2, "huan"), ("还", "zzz", 2, "zz"), ("山", "an", 1, "shan"), ("不还", "ai", 2, "hai"), ("也不还", "ei", 3, "hei")], SOUND)
    texts = ["天\n日还\n云\n青山", "天\n也不还。\n云\n 万不还", None, "", "x", "天\n还\n云\n山", "天\n日还\n云\n青山"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "i int, text string, phrase string")
    got = {r["i"]: {k: tuple(v) for k, v in (r["sounds"] or {}).items()} for r in with_sounds(df, table, positions=(2, 4, -1)).collect()}
    assert got[0] == {2: ("uan", 2, "huan"), 4: ("an", 1, "shan")} == got[5] == got[6]
    assert got[1] == {2: ("ei", 3, "hei"), 4: ("ai", 2, "hai")} and got[2] == got[3] == got[4] == {}
    scored = with_sounds(df, table).select("i", S.check_rhymes(F.col("text"), S.JoinedSounds(), (2, 4), "xinyun").alias("r"), S.check_two_rhymes(F.col("text"), S.JoinedSounds(), "xinyun").alias("t"))
    rows = {r["i"]: (r["r"]["ok"], r["t"]["ok"], r["r"]["tones"]) for r in scored.collect()}
    assert rows[0] == (True, True, {2: 2, 4: 1}) and rows[1][:2] == (False, False) and rows[2][:2] == (False, False)
    small = S.Pronunciation({"还": ("uan", 2, "huan"), "山": ("an", 1, "shan")})
    same = df.where("i in (0, 3, 4, 5)").select("i", S.check_rhymes(F.col("text"), small, (2, 4), "xinyun").alias("r"))
    assert {r["i"]: r["r"]["details"] for r in same.collect()} == {r["i"]: r["r"]["details"] for r in scored.where("i in (0, 3, 4, 5)").collect()}


def test_a_foot_that_a_third_of_all_rows_share(spark):
    rnd = random.Random(2)
    known = {f"{a}{b}": f"f{(ord(a) + ord(b)) % 5}" for a in "abcdef" for b in "abcdef"}
    table = spark.createDataFrame([(k, f, 1, k) for k, f in known.items()], SOUND)
    texts = ["\n".join("q" * rnd.randint(0, 3) + ("ab" if rnd.random() < 0.4 else rnd.choice("abcdefz") + rnd.choice("abcdefz")) for _ in range(4)) for _ in range(400)]
    got = {r["text"]: {k: v["final"] for k, v in (r["sounds"] or {}).items()} for r in with_sounds(spark.createDataFrame([(t,) for t in texts], "text string"), table, positions=(1, 2, 3, 4)).collect()}
    assert all(got[t] == {p: known[x[-2:]] for p, x in enumerate(t.split("\n"), 1) if x[-2:] in known} for t in texts)
