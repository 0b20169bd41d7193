from __future__ import annotations

import random

import pytest

from quatrain.llm import line_dedup


def likeness(a, b):
    a, b = (t.lower().split() for t in (a, b))
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a, b))
    return len(a & b) / len(a | b)


def brute(rows, least):
    sites, ids = {}, {}
    for d, t, s, *_ in rows:
        for line in (t or "").split("\n"):
            if line.strip(" \t\n\x0b\f\r"):
                sites.setdefault(line, set()).add(s or "")
                ids.setdefault(line, set()).add(d)
    spread = {x for x, s in sites.items() if len(s) >= least}
    keeper = {x: min((i for i in ids[x] if i is not None), default=None) for x in spread}
    texts = {}
    for d, t, *_ in rows:
        texts.setdefault(d, []).append(t or "")
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        cut = [x in spread and d != keeper[x] for x in lines]
        for k in {keeper[x] for x, c in zip(lines, cut) if c}:
            shared = [x for x, c in zip(lines, cut) if c and keeper[x] == k]
            if 3 * sum(map(len, shared)) > len(t) and any(3 * sum(map(len, set(shared))) > len(o) and likeness(t, o) >= 0.8 for o in texts[k]):
                cut = [False] * len(lines)
        text = t if not any(cut) else "\n".join(x for x, c in zip(lines, cut) if not c)
        out.append((d, text, sum(bool(x.strip(" \t\n\x0b\f\r")) for x in lines), sum(cut)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [2, 8])
def test_against_sets(spark, least):
    rnd = random.Random(3)
    shared = [f"shared line {i}" for i in range(25)]
    rows = []
    for d in range(200):
        lines = [f"own {d} {k}" for k in range(rnd.randint(0, 4))] + rnd.sample(shared, rnd.randint(0, 3)) + ["", " \t"][: rnd.randint(0, 2)]
        rnd.shuffle(lines)
        site = rnd.choice(["s0"] * 10 + [f"s{i}" for i in range(12)])
        rows.append((d, "\n".join(lines), site, "clash", 1))
    rows += [(500, None, "s1", "clash", 1), (501, "", None, "clash", 1), (None, "shared line 1\nother", None, "clash", 1), rows[7], rows[7], (7, "shared line 2", "s3", "clash", 1)]
    rows += [(600, "long " * 40_000 + "\nshared line 3", "s5", "clash", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, line string, place int")
    got = sorted(map(tuple, line_dedup.remove_spread_lines(df, min_sites=least).collect()), key=str)
    assert got == brute(rows, least)
    assert line_dedup.remove_spread_lines(df.limit(0)).count() == 0


def test_mostly_boilerplate_is_cut_and_copies_stay(spark):
    spread = ["follow us on all of our many channels", "all rights reserved by the owners of this site", "read our terms of use before you go on"]
    keeper = "\n".join([f"the first page is long and has line {k} of its own besides" for k in range(30)] + spread)
    rows = [(1, keeper, "s1")] + [(d, "\n".join([f"page {d} says {d * 7}", *spread]), f"s{d}") for d in range(2, 10)]
    prose = [" ".join(f"word{k}x{j}" for j in range(15)) for k in range(9)]
    rows += [(20 + k, "\n".join(p if i != k else f"{p} {k}" for i, p in enumerate(prose)), f"s{k}") for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_spread_lines(df).collect()}
    assert got == {d: t if d == 1 or d >= 20 else t.split("\n")[0] for d, t, _ in rows}


def test_shared_lines_alone_prove_no_copy(spark):
    """A page that is mostly what it shares with a keeper, and long enough to be told apart from it, is cut."""
    spread = [f"boilerplate line {k} with several words that many pages carry at their foot" for k in range(4)]
    rows = [(1, "\n".join([*spread, "the keeper has this one line of its own"]), "s1")]
    rows += [(d, "\n".join([f"page {d} tells a story of its own, number {d * 31}, in one long line of some twenty words that no other page of the web has", *spread]), f"s{d}") for d in range(2, 12)]
    rows += [(50, rows[0][1] + " indeed", "s50")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_spread_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all("boilerplate" not in got[d] for d in range(2, 12))
    assert got[50] == rows[-1][1] and got[1] == rows[0][1]
