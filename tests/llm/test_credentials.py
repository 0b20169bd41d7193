from __future__ import annotations

import hashlib
import re

from quatrain.llm import credentials as C

KEY = "AKIA" + "QX7" * 5 + "Z"
TEXTS = [
    "PassWord = 'abcdefghijkl' and token:short secret:token:abcdefghijklmnop",
    f"{KEY} AKIA123 xAKIA{'Z' * 14} deadbeefdeadbeef 0123456789abcde 0123456789abcdef0",
    "api-key=aaaaaaaaaaaaaaaa api_key=aaaaaaaaaaaa apikey\"  :  \"bbbbbbbbbbbbbb.",
    "paſſword=aaaaaaaaaaaaaaaa toKen=aaaaaaaaaaaaaaaa toKen=bbbbbbbbbbbbbbbb",
    "é𠀀 token=" + "x" * 100_000,
    "",
]


def brute(text: str):
    found = []
    pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    pattern = re.sub(r"(password|passwd|secret|token|api_\?key)", lambda m: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in m[0]), pattern)
    found += [(m.start(), 0, m.end()) for m in re.finditer(pattern, text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def test_base_spans():
    for t in TEXTS:
        assert sorted(C.base_spans(t)[0]) == brute(t)


def linked(text: str) -> list[str]:
    base, short = C.base_spans(text)
    return [(C.KINDS[k], text[s:e]) for s, k, e in sorted(C.linked_spans(text, base, short))]


def test_weak_parts_need_each_other():
    ident, secret, end = "login: bob.smith", "password=hunter2", "https://db.example.org/x"
    assert linked(ident) == linked(secret) == linked(end) == linked(f"{secret} {end}") == linked(f"{ident} {end}") == []
    assert linked(f"{ident} {secret} at {end}") == [("ident", ident), ("weak", secret), ("endpoint", end)]
    assert linked(ident + " " * 300 + secret) == []
    assert linked(f"{KEY} wJalrXUtnFEMI7K7MDENGbPxRfiCY") == [("weak", "wJalrXUtnFEMI7K7MDENGbPxRfiCY")]
    assert linked("the user asked for a token of thanks and a Countersignature1234567") == []


def test_operator(spark):
    texts = [*TEXTS, None, f"user=alice {KEY} password=hunter2 10.0.0.1:5432", TEXTS[0]]
    df = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r["doc_id"] or 0: r for r in C.scan_secrets(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base = brute(t or "")
        assert [got[i][c] for c in ("n_assign", "n_access", "n_hex")] == [sum(k == j for _, k, _ in base) for j in range(3)]
        joined = ",".join(f"{C.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(got[i]["spans"].split(","))
    assert [x.split(":")[0] for x in got[7]["spans"].split(",")] == ["ident", "access", "weak", "endpoint"]
    assert C.scan_secrets(df.limit(0)).count() == 0


def test_long_parts_are_linked_whole():
    token, url, name = "aB3dE5gH7jK9mN1pQ" * 24, "https://db.example.org/" + "x/" * 300, "bob." * 30
    assert linked(f"client_id: abc {token} {url}") == [("ident", "client_id: abc"), ("weak", token)]
    assert linked(f"client_id: abc {url} {token}") == []
    assert linked(f"{token} login: {name} password=hunter2 {url}") == [("weak", token), ("ident", f"login: {name}"), ("weak", "password=hunter2"), ("endpoint", url)]
    assert linked(f"login: bob token={'x' * 900}") == [("ident", "login: bob")]


def planted(rnd):
    """A text of parts at known places, and (kind, start, end) of each; fillers match nothing."""
    make = {
        "ident": lambda: ("user_id=", f"acct{rnd.randrange(10**5)}" + "x" * rnd.choice([0, 80])),
        "weak": lambda: ("password: ", "s3cr" + "et" * rnd.randint(1, 3)),
        "random": lambda: ("", "".join(rnd.sample("ABCDEFGHJKLM", 8) + rnd.sample("abcdefghjkm", 8) + rnd.sample("23456789", 6)) * rnd.choice([1, 15])),
        "assign": lambda: ("token=", "t" * rnd.choice([12, 40])),
        "access": lambda: ("", "AKIA" + "".join(rnd.choice("ABCDEFGH234567") for _ in range(16))),
        "endpoint": lambda: ("", "https://h.example.com/" + "p" * rnd.choice([3, 600])),
    }
    text, parts = "", []
    for _ in range(rnd.randint(0, 9)):
        text += " ".join(["so", "it", "went", "on"] * rnd.choice([1, 3, 12, 30])) + " \n"
        kind = rnd.choice(list(make))
        head, value = make[kind]()
        parts.append((kind, len(text), len(text) + len(head + value)))
        text += head + value + " "
    return text, parts


def test_linking_by_definition():
    """Every pair of parts is looked at: weak ones stay where an identifier and a secret are in one scope."""
    import random

    rnd, linked = random.Random(9), 0
    for _ in range(400):
        text, parts = planted(rnd)
        near = lambda a, p: p[1] <= a[2] + C.SCOPE and p[2] >= a[1] - C.SCOPE and p != a
        want = {(s, {"assign": 0, "access": 1}[k], e) for k, s, e in parts if k in ("assign", "access")}
        for a in parts:
            if a[0] in ("ident", "access"):
                secrets = [p for p in parts if p[0] in ("weak", "random", "assign") and near(a, p)]
                if secrets:
                    want |= {(a[1], 3, a[2])} if a[0] == "ident" else set()
                    want |= {(s, 4, e) for k, s, e in secrets if k != "assign"}
                    want |= {(p[1], 5, p[2]) for p in parts if p[0] == "endpoint" and near(a, p)}
        base, short = C.base_spans(text)
        got = set(base) | set(C.linked_spans(text, base, short))
        assert {g for g in got if g[1] != 2} == want, text
        linked += any(k > 2 for _, k, _ in want)
    assert linked > 80
