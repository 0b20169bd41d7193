from __future__ import annotations

from quatrain.llm import html_extract as H

MARKED = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body>
<nav><a href="/a">menu</a></nav><!-- x > y --><div class="ad">buy</div><article><h1>Head &amp; <i>tail</i></h1>
<p><b>One<br><p>two   three</p><div class="comment-list">me too</div><aside>side</aside><p>5 < 6 &copy</p>shared</article>
<footer>&copy; host</fo"""


def text(page: str) -> str:
    found, marked = H.blocks(page)
    return " ".join(x for x, chrome, inside in found if inside and not chrome) if marked else None


def test_marked_article():
    assert text(MARKED) == "Head & tail One two three 5 < 6 © shared"
    assert text('<main><p title="a>b">x</p><form>f</form></main><article>y</article>') == "x y"
    assert text("<article>a<script>never closed") == "a"
    assert H.blocks("") == ([], False)


def test_names_are_whole_tokens():
    for name in ("post social-science", "related-work", "ad-hoc-analysis", "menu-theory"):
        assert text(f'<article class="{name}"><p>x</p></article>') == "x"
        assert text(f'<article><div class="{name}">x</div>y</article>') == "x y"
    for name in ("comment-list", "ad", "cookie-notice", "Share-Buttons", "related-posts", "promo_box-2"):
        assert text(f'<article>y<div class="{name}">x</div></article>') == "y"
    assert text('<article class="comment">only one</article>') == "only one"
    assert text('<article>y<article class="comment">said a reader</article></article>') == "y"
    assert text("<main></main><p>real text</p>") is None and text("<main><nav>a</nav></main><p>real text</p>") is None


def test_names_inside_articles():
    for name in (
        "user-comments", "comment-respond", "commentlist", "reader-comments", "responses", "ad-slot-728x90", "adsbygoogle", "newsletter-signup-cta", "share-this", "sponsoredContent",
        "hidden", "sr-only", "userComments", "sidebarLeft", "cookiebanner",
    ):
        assert text(f'<article><p>y</p><div class="{name}">x</div></article>') == "y", name
    for name in ("commentary", "shareholders", "relatedness", "socialist", "adaptation", "menuhin", "content", "main-title", "reader", "promotion-of-health", "navy", "x2", "responsibility"):
        assert text(f'<article><p>y</p><div class="{name}">x</div></article>') == "y x", name
    for attributes in ("hidden", "hidden=''", 'aria-hidden="true"', "style='color:red; display : none'", 'id="a" hidden'):
        assert text(f"<article>y<div {attributes}>x</div></article>") == "y", attributes
    for attributes in ('title="it is hidden in the text"', 'style="display:block"', 'aria-hidden="false"', 'data-x="none"'):
        assert text(f"<article>y<div {attributes}>x</div></article>") == "y x", attributes


def visible(page: str) -> list[tuple[str, bool]]:
    """Words of simple pages of p, div and nav elements, and whether they stand in nav: written without the operator."""
    import re

    out, depth = [], 0
    for tag, word in re.findall(r"<(/?nav)>|<[^>]*>|([^<>\s]+)", page):
        depth += {"nav": 1, "/nav": -1}.get(tag, 0)
        if word:
            out.append((word, depth > 0))
    return out


def brute_open(pages: dict[int, tuple[str, str]], outside: list[tuple[str, list[str]]], depth: int) -> dict[int, str]:
    """pages: host and page of open pages; outside: host and words of other pages beside their articles."""
    contents: dict[str, set[tuple]] = {}
    for host, page in pages.values():
        contents.setdefault(host, set()).add(tuple(w for w, _ in visible(page)))
    for host, words in outside:
        contents.setdefault(host, set()).add(tuple(words))
    grams = {h: [{c[j : j + depth] for j in range(len(c) - depth + 1)} for c in cs if len(c) >= depth] for h, cs in contents.items()}
    out = {}
    for k, (host, page) in pages.items():
        words, covered = visible(page), set()
        known = grams[host]
        for i in range(len(words) - depth + 1):
            s = tuple(w for w, _ in words[i : i + depth])
            n = sum(s in c for c in known)
            if n >= H.MIN_CONTENTS and n >= H.MIN_SHARE * len(known):
                covered |= set(range(i, i + depth))
        out[k] = " ".join(w for i, (w, chrome) in enumerate(words) if i not in covered and not chrome)
    return out


def test_open_pages(spark):
    import random

    rnd = random.Random(3)
    line = "all our pages say this very same long line of words"
    bodies = {
        1: f"<body><div>{line}</div><p>own words of page one</p><nav>home about</nav></body>",
        2: f"<body><div>{line}</div><p>what page two has to say is its own</p><nav>home about</nav></body>",
        3: f"<body><div>{line}</div></body>",
        4: "<p>short</p>",
        5: "<p>a a a a a a a a a a a a a a a a a</p>",
    }
    urls = {1: "http://h/1", 2: "http://h/2", 3: "http://other/", 4: None, 5: "http://h/5"}
    shared = [" ".join(rnd.choice("abcdefgh") * 2 for _ in range(12)) for _ in range(4)]
    for k in range(20, 80):
        own = [" ".join(f"w{rnd.randrange(50)}" for _ in range(rnd.randint(0, 30))) for _ in range(3)]
        parts = [f"<p>{x}</p>" for x in own + rnd.sample(shared, rnd.randint(0, 2))]
        rnd.shuffle(parts)
        bodies[k] = "".join(parts) + f"<nav>{rnd.choice(shared)}</nav>"
        urls[k] = f"http://host{k % 3}/{k}"
    bodies[80], urls[80] = " ".join(f"<p>long {i % 97} page {i}</p>" for i in range(20_000)), "http://host1/long"
    rows = [(k, urls[k], b, 1, "x") for k, b in bodies.items()]
    rows += [(6, "http://h/6", MARKED, 1, "x"), (7, "http://[bad", None, 1, "x"), (None, "", "", 1, "x"), rows[0], rows[3]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, key int, text string")
    got = {}
    result = H.extract_main_text(df).collect()
    assert len(result) == len(rows)
    for r in result:
        assert got.setdefault(r["page_id"], r) == r and r["n_chars"] == len(r["text"])
    beside = "menu buy me too side © host".split()
    hosts = {k: ("" if u is None else u.split("/")[2], bodies[k]) for k, u in urls.items()}
    want = brute_open(hosts, [("h", beside)], H.MIN_TOKENS)
    assert {k: got[k]["text"] for k in bodies} == want
    assert got[1]["text"] == "own words of page one" and got[3]["text"] == line
    assert got[6]["text"] == text(MARKED) and got[7]["text"] == "" and got[None]["text"] == ""
    assert H.extract_main_text(df.limit(0)).count() == 0


def test_copies_and_shared_passages_of_open_pages(spark):
    menu, passage = "all our pages say this very same long line of words", "a passage that two articles of this large host both cite in full"
    body = lambda k, more="": f"<body><div>{menu}</div><p>p{k} has its own words</p><p>{more}</p></body>"
    alone = "<p>this page stands alone on its host but under two or more page ids</p>"
    rows = [(1, "http://c/1", alone), (2, "http://c/2", alone.replace("<p>", "<p id=x>"))]
    rows += [(100 + k, f"http://big/{k}", body(k, passage if k < 2 else "")) for k in range(40)]
    rows += [(200 + k, f"http://big/copy{k}", body(0, passage)) for k in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.extract_main_text(df).collect()}
    assert got[1] == got[2] == "this page stands alone on its host but under two or more page ids"
    assert got[101] == f"p1 has its own words {passage}" and got[100] == got[200] == got[219] == f"p0 has its own words {passage}"
    assert got[105] == "p5 has its own words"


def brute_articles(pages: dict[int, tuple[str, list[tuple[str, bool]]]]) -> dict[int, str]:
    """pages: host and an article's paragraphs, each a box or plain. Written without the operator: a box goes if strings in it
    that half of the host's distinct articles, and three, hold cover its words."""
    grams = lambda w: {tuple(w[i : i + H.MIN_TOKENS]) for i in range(len(w) - H.MIN_TOKENS + 1)}
    articles: dict[str, set[tuple]] = {}
    for host, parts in pages.values():
        words = tuple(w for text, _ in parts for w in text.split())
        if len(words) >= H.MIN_TOKENS:
            articles.setdefault(host, set()).add(words)
    known = {h: [grams(a) for a in found] for h, found in articles.items()}
    out = {}
    for k, (host, parts) in pages.items():
        kept = []
        for text, box in parts:
            words, covered = text.split(), set()
            for i in range(len(words) - H.MIN_TOKENS + 1):
                n = sum(tuple(words[i : i + H.MIN_TOKENS]) in a for a in known[host])
                if n >= H.BOX_CONTENTS and n >= H.BOX_SHARE * len(known[host]):
                    covered |= set(range(i, i + H.MIN_TOKENS))
            if not box or len(covered) < len(words):
                kept.append(text)
        out[k] = " ".join(kept or [text for text, _ in parts])
    return out


def test_articles_go_through_their_host_s_arrays(spark, monkeypatch):
    import random

    rnd = random.Random(5)
    letter, passage = "write to us and get the weekly letter of our house for free", "a passage that all articles of this host cite in full and in plain paragraphs"
    pages, rows = {}, []
    for k in range(90):
        parts = [(" ".join(f"w{rnd.randrange(60)}" for _ in range(rnd.randint(0, 25))) or "x", rnd.random() < 0.2) for _ in range(2)]
        parts += [(passage, False)] + [(letter, True)] * (rnd.random() < (0.9, 0.4, 0.6)[k % 3]) + [(f"{letter} signed by w{k}", True)] * (rnd.random() < 0.2)
        rnd.shuffle(parts)
        pages[k] = (f"host{k % 3}", parts)
    pages |= {90: ("small", [(letter, True), ("one", False)]), 91: ("small", [(letter, True), ("two", False)]), 92: ("host0", [(letter, True)])}
    pages |= {k: pages[1] for k in range(100, 140)}
    for k, (host, parts) in pages.items():
        body = "".join(f'<div class="zephyr-{k}"><p>{t}</p></div>' if box else f"<p>{t}</p>" for t, box in parts)
        rows.append((k, f"http://{host}/{k}", f"<nav>{letter}</nav><article class=odd>{body}</article>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = brute_articles(pages)
    # the arrays are whole, or in buckets of a few pages
    for size in (H.BUCKET_PAGES, 7):
        monkeypatch.setattr(H, "BUCKET_PAGES", size)
        assert {r["page_id"]: r["text"] for r in H.extract_main_text(df).collect()} == want, size
    cut = {host for k, (host, parts) in pages.items() if (letter, True) in parts and letter not in want[k]}
    assert "host0" in cut and "small" not in cut
    assert want[90] == f"{letter} one" and want[92] == letter and all(passage in want[k] for k in range(90))


def test_names_that_leave_a_block_unsettled():
    boxes = lambda page: [b[3] for b in H.boxed_blocks(page)[0]]
    assert boxes('<article class="zephyr"><p>a<div class="zephyr"><p>b<p>c</div>d<section id="post-list">e</section><p class="lede">f</p></article>') == [0, 1, 1, 0, 0, 2]
    assert boxes('<div class="zephyr">a</div><article><div class="ad zephyr">b</div>c</article>') == [0, 0, 0]
