from __future__ import annotations

import random

import numpy as np

from quatrain.llm import decontaminate as D


def brute_edits(item: list[str], text: list[str]) -> int:
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(text, 1):
            new.append(min(row[j - 1] + (v != w), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rnd, words, k):
    out = list(words)
    for _ in range(k):
        at = rnd.randrange(len(out))
        kind = rnd.randrange(3)
        if kind == 0:
            out[at] = f"new{rnd.randrange(99)}"
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, f"new{rnd.randrange(99)}")
    return out


def test_alignment():
    rnd = random.Random(1)
    for _ in range(100):
        item = [rnd.choice("abcd") for _ in range(rnd.randint(1, 8))]
        text = [rnd.choice("abcd") for _ in range(rnd.randint(0, 14))]
        code = lambda x: np.array([ord(c) for c in x], np.int64)
        assert D.edits_to_passage(code(item), code(text)) == brute_edits(item, text)


def test_recall_and_precision(spark):
    rnd = random.Random(4)
    pool = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 60
    items = [(i, " ".join(rnd.choice(pool) for _ in range(rnd.randint(8, 60)))) for i in range(40)]
    items += [(90, "two words"), (91, None), (92, ""), (93, "five words are enough here")]
    docs = []
    for d in range(240):
        body = [rnd.choice(pool) for _ in range(rnd.randint(0, 300))]
        if d % 2:
            item = D.words_of(rnd.choice(items[:40])[1])
            at = rnd.choice([0, len(body), rnd.randint(0, len(body))])
            body[at:at] = edited(rnd, item, rnd.randint(0, int(D.MOST_EDITS * len(item)) + 2))
        docs.append((d, " ".join(body).upper() if d % 3 else " \n".join(body), "x", [1]))
    docs += [(900, None, "x", [1]), (901, "", "x", [1]), (902, "Five, words are enough HERE!", "x", [1]), (903, "two words", "x", [1]), docs[5], docs[5]]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string, leaks array<int>")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r["doc_id"], r["item_id"], r["edits"]) for r in D.find_leaks(df, bench).collect()]
    want = set()
    for d, text, *_ in docs:
        words = D.words_of(text or "")
        for i, body in items:
            item = D.words_of(body or "")
            if item and (e := brute_edits(item, words)) <= int(D.MOST_EDITS * len(item)):
                want.add((d, i, e))
    assert set(got) <= want
    assert len(set(got)) >= 0.98 * len(want) and len(want) > 80
    assert {w for w in want if w[2] <= 3} <= set(got)
    assert sum(g[0] == 5 for g in got) == 3 * sum(g[0] == 5 for g in set(got))
    assert D.find_leaks(df.limit(0), bench).count() == 0 and D.find_leaks(df, bench.limit(0)).count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    items = [(i, f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(9)]
    df = spark.createDataFrame([(1, " ".join(t for _, t in items[:5])), (2, items[7][1])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, D.find_leaks(df, bench).collect()))
    monkeypatch.setattr(D, "BLOCK_CHARS", 40)
    assert sorted(map(tuple, D.find_leaks(df, bench).collect())) == whole and len(whole) == 6


def test_long_items_go_by_pieces(spark):
    rnd = random.Random(8)
    pool = [f"w{i}" for i in range(3000)] + ["the", "of", "and"] * 200
    prose = lambda k: [rnd.choice(pool) for _ in range(k)]
    item = prose(6000)
    near = edited(rnd, item, 300)
    clean = prose(9000)
    docs = [("a", prose(200) + near + prose(3000)), ("b", clean), ("c", clean[:50] + item[1000:1400] + clean[50:]), ("d", near[:4700])]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id string, text string")
    bench = spark.createDataFrame([("long", " ".join(item)), ("part", " ".join(item[1000:1200]))], "item_id string, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in D.find_leaks(df, bench).collect()}
    code = {w: i for i, w in enumerate({w for _, d in docs for w in d} | set(item))}
    number = lambda ws: np.array([code[w] for w in ws], np.int64)
    want = {}
    for name, x in (("long", item), ("part", item[1000:1200])):
        for d, text in docs:
            e = D.edits_to_passage(number(x), number(text))
            if e <= int(D.MOST_EDITS * len(x)):
                want[d, name] = e
    assert got == want and ("a", "long") in got and ("c", "part") in got and "b" not in {d for d, _ in got}


def test_short_items_and_scripts_without_blanks(spark):
    items = [(1, "two words"), (2, "one"), (3, "床前明月光"), (4, "...")]
    docs = [(1, "these Two, words"), (2, "two other words"), (3, "他说床前明月光是诗"), (4, "床前月光"), (5, "one!")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("cast(item_id as decimal(9,0)) item_id", "text")
    got = sorted((r["doc_id"], int(r["item_id"]), r["edits"]) for r in D.find_leaks(df, bench).collect())
    assert got == [(1, 1, 0), (3, 3, 0), (4, 3, 1), (5, 2, 0)]


def test_least_words_and_repeated_items(spark):
    import time

    from quatrain.llm.decontaminate import LeakIndex, find_leaks, mark_leaks, words_of

    items = spark.createDataFrame([(1, "the"), (2, "one two three four"), (3, "日本語文字"), (4, "one two three four five")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "the one two three four five"), (2, "x 日本語文字 y")], "doc_id long, text string")
    found = lambda n: {(r["doc_id"], x["item_id"]) for r in mark_leaks(docs, items, least_words=n).collect() for x in r["leaks"]}
    assert found(1) == {(1, 1), (1, 2), (1, 4), (2, 3)} and found(5) == {(1, 4), (2, 3)}
    assert len(words_of("日本語文字")) == 5 and find_leaks(docs, items).count() == 4
    # a text that repeats an item with an edit takes time in proportion to its length
    item = [f"w{i}" for i in range(10)]
    index, took = LeakIndex([(1, " ".join(item))]), []
    for n in (1000, 4000):
        text = " ".join(" ".join([*item[:5], "other", *item[6:]]) for _ in range(n))
        begin = time.process_time()
        assert index.leaks([text]) == [[(1, 1)]]
        took.append(time.process_time() - begin)
    assert took[1] < 9 * took[0]
