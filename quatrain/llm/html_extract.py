"""Main text of web pages: markup as a prior, then a host's suffix arrays for what markup leaves open.

A page's visible text is cut into blocks. Blocks in menus, headers, footers, sidebars, notices, adverts, forms and
reader comments (by element, role or class) are no main text. If the page's article (main or article elements) holds
text, its other blocks are the main text. If there is none, every block that is left is open. All pages then go through
the suffix arrays of their host, which find strings of MIN_TOKENS tokens that distinct contents repeat, in two families
of token streams: the articles, and what the host's pages hold outside of them (open pages: all of it).

* Open tokens that strings repeated outside articles cover are removed. A string is repeated if MIN_CONTENTS distinct
  contents of its family hold it, and MIN_SHARE of them.
* Inside an article plain blocks are settled, whatever other pages repeat of them, because pages may share passages. What
  names leave unsettled is a box: an element whose class or id says something that is neither chrome nor layout. A box is
  removed if strings that lie in it, and that BOX_CONTENTS distinct articles of the host and BOX_SHARE of them hold, cover
  all of its own tokens (a notice of an odd name); no part of a box is cut, and no article is emptied.

Copies of a page are one content. The arrays are sorted to MIN_TOKENS tokens: a longer repeated string is covered by its
parts of that length, which are repeated as well.

Class and id names count as whole tokens: a name is no main text if each of its parts (at hyphens, underscores and capitals;
glued parts are taken apart) is a chrome name, says something about layout or is a measure, and one is a chrome name
(comment-list, commentlist, sponsoredContent and ad-slot-728x90, but not social-science). Names do not bear on the outermost
article element. What is hidden (attribute, style or name) is no main text either.

Scale: each page is parsed once, and its blocks are written to the shared folder. A host's streams are dealt to buckets of
some BUCKET_PAGES pages by their content, packed. A bucket's suffix array says which strings are repeated in it. What is
repeated in a share of a host's contents is repeated in that share of some bucket's contents, so no other string needs to
be counted over the host; buckets are counted a second time for these alone, where a page is open or has a box. That is
what one array over the whole host would say, for a host of any size.

Defined results: a null or empty page has the empty text; a null or unparsable URL belongs to the host ""; rows that
repeat a page count as one page and get equal rows; pages that differ only in their ids get equal texts; very long pages
are treated like any other; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quatrain.llm.common import materialize, text_or_empty

MIN_TOKENS = 8
#: A string is repeated if so many distinct contents of the host hold it, and so large a share of them.
MIN_CONTENTS, MIN_SHARE = 2, 0.1
#: The same inside articles, for boxes.
BOX_CONTENTS, BOX_SHARE = 3, 0.5
#: Pages that are parsed at a time.
PAGES = 1024
#: Pages of a host, and signs of them, that a bucket has about.
BUCKET_PAGES, BUCKET_SIGNS = 256, 4_000_000
#: Copies that a task remembers, so that it sends them once.
COPIES = 100_000

CHROME_TAGS = frozenset("nav footer aside form noscript template iframe svg select button dialog menu head object canvas audio video map".split())
CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent gdpr notice popup modal overlay "
    "sidebar comment comments commenter respond responses response replies reply disqus share sharing social related recommended newsletter subscribe "
    "subscription signup login menu nav navbar adsbygoogle adsense adslot outbrain taboola paywall cta "
    "navigation breadcrumb breadcrumbs footer masthead toolbar pagination widget".split()
)
#: Parts of names that say where or how something stands, or what it is made of.
LAYOUT_NAMES = frozenset(
    "list item items box block section area container wrapper wrap inner outer content body top bottom left right center bar row col column group "
    "panel links link buttons button icons icon text title heading head thread form field posts post articles article stories story media module unit slot "
    "main primary secondary site page global fixed sticky mobile desktop small large new the in of this by user users reader readers form count "
    "slot zone tag tags bottom outer first last no your our up to".split()
)
HIDDEN_NAMES = frozenset("hidden hide invisible sr-only visually-hidden visuallyhidden screen-reader-text d-none display-none u-hidden is-hidden".split())
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)""", re.IGNORECASE)
HIDDEN_BY = re.compile(r"""aria-hidden\s*=\s*["']?true|style\s*=\s*(?:"[^"]*|'[^']*)(?:display\s*:\s*none|visibility\s*:\s*hidden)""", re.IGNORECASE)
QUOTED = re.compile(r"""=\s*(?:"[^"]*"|'[^']*')""")
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe xmp".split())
INLINE_TAGS = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output progress q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a following block closes if they are still open.
LOOSE_TAGS = frozenset("p li dt dd option tr td th".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
#: Where a name falls into parts: at signs, and ahead of a capital that follows a small letter or a digit.
PARTS = re.compile(r"[-_]+|(?<=[a-z0-9])(?=[A-Z])")
MEASURE = re.compile(r"[\dx]+")


def _known_parts(part: str) -> list[str] | None:
    """The part itself, or two known names that it glues together; None if it says something else."""
    if part in CHROME_NAMES or part in LAYOUT_NAMES or MEASURE.fullmatch(part):
        return [part]
    for k in range(3, len(part) - 2):
        halves = [part[:k], part[k:]]
        if all(h in CHROME_NAMES or h in LAYOUT_NAMES for h in halves):
            return halves
    return None


@lru_cache(65536)
def _chrome_name(name: str) -> bool:
    if name.lower() in HIDDEN_NAMES:
        return True
    parts = [_known_parts(p.lower()) for p in PARTS.split(name) if p]
    return all(p is not None for p in parts) and any(x in CHROME_NAMES for p in parts for x in p)


def _is_chrome(tag: str, attributes: str, names: bool = True) -> bool:
    if tag in CHROME_TAGS:
        return True
    if not attributes:
        return False
    if ("hidden" in attributes or "none" in attributes) and (HIDDEN_BY.search(attributes) or HIDDEN.search(QUOTED.sub("=", attributes))):
        return True
    if "=" not in attributes:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            if value.strip().lower() in CHROME_ROLES:
                return True
        elif names and any(map(_chrome_name, value.split())):
            return True
    return False


def _is_odd(attributes: str) -> bool:
    """Whether a class or id says something that is neither chrome nor layout."""
    names = (n for m in ATTRIBUTE.finditer(attributes) if m[1].lower() != "role" for n in (m[2] or m[3] or m[4] or "").split())
    return any(_known_parts(p.lower()) is None for n in names for p in PARTS.split(n) if p)


def blocks(page: str) -> tuple[list[tuple[str, bool, bool]], bool]:
    """(text, in chrome, in article) of the page's blocks in order, and whether its article holds text."""
    found, marked = boxed_blocks(page)
    return [b[:3] for b in found], marked


def boxed_blocks(page: str) -> tuple[list[tuple[str, bool, bool, int]], bool]:
    """The same, with the number of the innermost box in the article that holds a block; 0 is none."""
    out: list[tuple[str, bool, bool, int]] = []
    stack: list[tuple[str, bool, bool, int]] = []  # element, in chrome, in article, box
    held: list[str] = []
    chrome = article = False
    box = boxes = 0

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append((text, chrome, article, box))

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            held.append(html.unescape(page[at:]))
            break
        if lt > at:
            held.append(html.unescape(page[at:lt]))
        follows = page[lt + 1 : lt + 2]
        if follows in "!?" and follows:
            end = page.find("-->", lt + 2) if page.startswith("<!--", lt) else page.find(">", lt)
            at = size if end < 0 else end + (3 if page.startswith("<!--", lt) else 1)
            continue
        m = TAG.match(page, lt)
        if m is None:
            if re.match(r"/?[a-zA-Z]", page[lt + 1 : lt + 3]):  # a tag that the page's end cuts off
                break
            held.append("<")
            at = lt + 1
            continue
        at = m.end()
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if tag in RAW_TAGS and not closing and not attributes.endswith("/"):
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
            at = size if end is None else end.end()
            continue
        if tag in INLINE_TAGS and (closing or not attributes or not _is_chrome(tag, attributes)):
            if not closing or not any(e[0] == tag for e in stack):
                continue
        flush()
        if tag in VOID_TAGS:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        else:
            if stack and stack[-1][0] in LOOSE_TAGS and (stack[-1][0] == tag or stack[-1][0] == "p"):
                stack.pop()
            above = stack[-1] if stack else ("", False, False, 0)
            root = tag in ("main", "article") or "main" in attributes and re.search(r"""role\s*=\s*["']?main""", attributes) is not None
            bad = above[1] or _is_chrome(tag, attributes, not root or above[2]) or tag == "header" and not above[2]
            if not attributes.endswith("/"):
                own = above[3]
                if above[2] and not bad and "=" in attributes and _is_odd(attributes):
                    own = boxes = boxes + 1
                stack.append((tag, bad, above[2] or root and not bad, own))
        chrome, article, box = stack[-1][1:] if stack else (False, False, 0)
    flush()
    return out, any(inside and not bad for _, bad, inside, _ in out)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def suffix_order(tokens: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of integer tokens by prefix doubling, compared over the first depth tokens; and each position's
    rank. ends: position behind each token's page; strings never reach over it."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    length = 1
    place = np.arange(n)
    while length < depth:
        step = min(length, depth - length)
        behind = np.zeros(n, np.int64)
        there = place + step < ends
        behind[there] = rank[place[there] + step]
        rank = np.unique(rank * (n + 2) + behind, return_inverse=True)[1].astype(np.int64) + 1
        length += step
    return np.argsort(rank, kind="stable"), rank


def string_hashes(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Hash of the depth tokens from each position, as far as there are that many."""
    out = np.zeros(max(0, len(tokens) - depth + 1), np.uint64)
    for k in range(depth):
        out = (out ^ tokens[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def token_numbers(tokens: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(t) for t in tokens), np.uint64, len(tokens))


def stream(found: list[dict]) -> tuple[list[str], list[bool]]:
    """Tokens of blocks (text, chrome), and whether they are chrome."""
    words = [(w, b["chrome"]) for b in found for w in b["text"].split()]
    return [w for w, _ in words], [c for _, c in words]


def content_of(text: str) -> int:
    """Equal for copies."""
    import xxhash

    return np.uint64(xxhash.xxh64_intdigest(text)).astype(np.int64).item()


#: Families of streams, by what a page's text hangs on, and from when on a string is repeated in them.
OUTSIDE, INSIDE = 0, 1
REPEATED = {OUTSIDE: (MIN_CONTENTS, MIN_SHARE), INSIDE: (BOX_CONTENTS, BOX_SHARE)}
OUTSIDE_BLOCKS, INSIDE_BLOCKS = "array<struct<text:string,chrome:boolean>>", "array<struct<text:string,box:int>>"
PARCEL = "host string, family int, bucket int, buckets int, size long, lines binary"
FOUND = "host string, family int, bucket int, string long, of long, asks boolean"
HELD = "host string, family int, string long, content long, n long"


def article_text(found: list[dict], repeated: set[int]) -> str:
    """Blocks of an article (text, box) without the boxes that repeated strings cover."""
    words = [(w, b["box"]) for b in found for w in b["text"].split()] if repeated else []
    covered = [False] * len(words)
    for i, h in enumerate(string_hashes(token_numbers([w for w, _ in words]), MIN_TOKENS).tolist()):
        if h in repeated and words[i][1] and len({b for _, b in words[i : i + MIN_TOKENS]}) == 1:
            covered[i : i + MIN_TOKENS] = [True] * MIN_TOKENS
    gone = {b for _, b in words if b} - {b for (_, b), c in zip(words, covered, strict=True) if not c}
    return " ".join(b["text"] for b in found if b["box"] not in gone) or " ".join(b["text"] for b in found)


def unique_runs(found: list[dict], repeated: set[int]) -> str:
    """Open tokens that no repeated string covers; the stream holds chrome as well, as other pages' streams do."""
    words, chrome = stream(found)
    left = [0] * (len(words) + 1)
    for i, h in enumerate(string_hashes(token_numbers(words), MIN_TOKENS).tolist()):
        if h in repeated:
            left[i] += 1
            left[i + MIN_TOKENS] -= 1
    depth, kept = 0, []
    for w, bad, step in zip(words, chrome, left, strict=False):
        depth += step
        if not depth and not bad:
            kept.append(w)
    return " ".join(kept)


def parsed_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, url, host, signs of text, family and content of the stream that the page's text hangs on (content null if
    nothing is open), blocks outside the article (open page: all), and blocks of main text in it."""
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    added = T._parse_datatype_string(f"host string, signs long, family int, content long, outside {OUTSIDE_BLOCKS}, inside {INSIDE_BLOCKS}")
    schema = T.StructType([source.schema["page_id"], source.schema["url"], *added.fields])
    kinds = [to_arrow_type(f.dataType) for f in added.fields]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, PAGES) for b in batches for at in range(0, b.num_rows, PAGES)):
            rows: list[tuple] = []
            for url, page in zip(batch.column(1).cast(pa.string()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found, marked = boxed_blocks(page)
                inside = [{"text": x, "box": box} for x, bad, within, box in found if marked and within and not bad]
                outside = [{"text": x, "chrome": bad} for x, bad, within, _ in found if not (marked and within)]
                asks = any(b["box"] for b in inside) if marked else bool(found)
                content = content_of(" ".join(b["text"] for b in (inside if marked else outside))) if asks else None
                rows.append((host_of(url), sum(len(x[0]) for x in found), INSIDE if marked else OUTSIDE, content, outside, inside))
            made = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=schema.names)

    return pages.select(F.col(id_col), F.col(url_col), text_or_empty(html_col)).mapInArrow(parse, schema)


def parcels(parsed: DataFrame, hosts: DataFrame) -> DataFrame:
    """Streams of the pages, packed by host, family and bucket: a line each, with a sign ahead that says whether the text of
    a page hangs on it. Copies fall into one bucket, and a task sends them once. hosts: those of several buckets."""
    schema = T._parse_datatype_string(PARCEL)
    source = parsed.join(F.broadcast(hosts), "host", "left").select("host", F.coalesce("buckets", F.lit(1)).alias("buckets"), "family", "content", "outside", "inside")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in (b.slice(at, PAGES) for b in batches for at in range(0, b.num_rows, PAGES)):
            held: dict[tuple, list[str]] = {}
            host, buckets, family, content = (batch.column(i).to_pylist() for i in range(4))
            for which, column in ((OUTSIDE, batch.column(4)), (INSIDE, batch.column(5))):
                for k, found in enumerate(column.to_pylist()):
                    line = " ".join(b["text"] for b in found)
                    if line.count(" ") < MIN_TOKENS - 1:
                        continue
                    asks = content[k] is not None and family[k] == which
                    key = (host[k], which, asks, number := content_of(line))
                    if key not in seen:
                        if len(seen) >= COPIES:
                            seen.clear()
                        seen.add(key)
                        held.setdefault((host[k], which, number % buckets[k], buckets[k]), []).append(("1" if asks else "0") + line)
            if held:
                plain = ["\n".join(lines).encode() for lines in held.values()]
                packed = [pa.compress(x, codec="zstd", asbytes=True) for x in plain]
                columns = [*zip(*held, strict=True), list(map(len, plain)), packed]
                yield pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, schema.fields, strict=True)], names=schema.names)

    return source.mapInArrow(pack, schema)


def unpacked(packed: pa.Table) -> tuple[list[int], list[bool], list[np.ndarray]]:
    """Distinct contents of parcels, whether a text hangs on them, and their tokens."""
    streams: dict[int, np.ndarray] = {}
    asking: set[int] = set()
    for size, lines in zip(packed.column("size").to_pylist(), packed.column("lines").to_pylist(), strict=True):
        for line in pa.decompress(lines, size, codec="zstd", asbytes=True).decode().split("\n"):
            content = content_of(line[1:])
            if line[0] == "1":
                asking.add(content)
            if content not in streams:
                streams[content] = token_numbers(line[1:].split(" "))
    return list(streams), [c in asking for c in streams], list(streams.values())


def repeated_in_bucket(key: tuple, packed: pa.Table) -> pa.Table:
    """Strings that are repeated in a bucket, by its suffix array; and a row without a string, for its number of contents."""
    host, family, bucket = (k.as_py() for k in key)
    contents, asking, streams = unpacked(packed)
    sizes = np.array([len(s) for s in streams])
    ends, owner, tokens = np.repeat(np.cumsum(sizes), sizes), np.repeat(np.arange(len(sizes)), sizes), np.concatenate(streams)
    order, rank = suffix_order(tokens, ends, MIN_TOKENS)
    order = order[order + MIN_TOKENS <= ends[order]]
    # equal strings stand side by side; each counts once a content
    pairs = np.unique(rank[order] * len(sizes) + owner[order])
    ranks, n = np.unique(pairs // len(sizes), return_counts=True)
    least, share = REPEATED[family]
    alone = packed.column("buckets")[0].as_py() == 1
    # rounding must not lose a string that is counted again
    wanted = ranks[(n + 1e-6 >= share * len(sizes)) & (n >= (least if alone else 1))]
    place = np.empty(int(rank.max()) + 1, np.int64)
    place[rank[order]] = order
    strings = [None, *string_hashes(tokens, MIN_TOKENS)[place[wanted]].tolist()]
    rows = len(strings)
    return pa.table([pa.array([host] * rows, pa.string()), pa.array([family] * rows, pa.int32()), pa.array([bucket] * rows, pa.int32()), pa.array(strings, pa.int64()), pa.array([len(sizes)] * rows, pa.int64()), pa.array([any(asking)] * rows)], names=[c.split()[0] for c in FOUND.split(", ")])


def held_in_bucket(key: tuple, packed: pa.Table, strings: pa.Table) -> pa.Table:
    """In how many contents of a bucket each string stands (content null), and in which of those that a text hangs on."""
    rows: list[tuple] = []
    if packed.num_rows and strings.num_rows:
        wanted, counts = np.array(strings.column("string").to_pylist(), np.int64), {}
        contents, asking, streams = unpacked(packed)
        for content, asks, tokens in zip(contents, asking, streams, strict=True):
            for x in np.intersect1d(string_hashes(tokens, MIN_TOKENS), wanted).tolist():
                counts[x] = counts.get(x, 0) + 1
                if asks:
                    rows.append((x, content, 0))
        rows += [(x, None, n) for x, n in counts.items()]
    of = [pa.array([k.as_py()] * len(rows), kind) for k, kind in zip(key, (pa.string(), pa.int32()), strict=False)]
    return pa.table([*of, *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3))], names=[c.split()[0] for c in HELD.split(", ")])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars of every page."""
    parsed, _ = materialize(parsed_pages(pages, id_col, url_col, html_col), "pages")
    covered = covered_contents(parsed)
    asking = parsed.where("content is not null").join(covered, ["host", "family", "content"], "left")
    settled = parsed.where("content is null").withColumn("strings", F.lit(None).cast("array<long>"))
    columns = ["page_id", "url", "family", "outside", "inside", "strings"]
    rows = settled.select(*columns).unionByName(asking.select(*columns))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            family, outside, inside, strings = (batch.column(i).to_pylist() for i in range(2, 6))
            texts = [article_text(i, set(s or ())) if f == INSIDE else unique_runs(o, set(s or ())) for f, o, i, s in zip(family, outside, inside, strings, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    text = rows.mapInArrow(finish, T.StructType([parsed.schema["page_id"], parsed.schema["url"], T.StructField("text", T.StringType())]))
    return text.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


def covered_contents(parsed: DataFrame) -> DataFrame:
    """host, family, content and the host's repeated strings in it, of the streams that a text hangs on."""
    buckets = F.greatest(F.ceil(F.count("*") / BUCKET_PAGES), F.ceil(F.sum("signs") / BUCKET_SIGNS)).cast("int")
    hosts, _ = materialize(parsed.groupBy("host").agg(buckets.alias("buckets")).where("buckets > 1"), "hosts")
    packed, key = parcels(parsed, hosts), ["host", "family", "bucket"]
    found, _ = materialize(packed.groupBy(*key).applyInArrow(repeated_in_bucket, FOUND), "strings")
    of = found.where("string is null").groupBy("host", "family").agg(F.sum("of").alias("of"), F.bool_or("asks").alias("asks")).where("asks").drop("asks")
    strings, _ = materialize(found.where("string is not null").select("host", "family", "string").distinct().join(of, ["host", "family"]), "wanted")
    empty = parsed.select("host", "family", "content", F.lit(None).cast("array<long>").alias("strings")).limit(0)
    if strings.isEmpty():
        return empty
    # each bucket of the host looks for all of its strings
    looked = found.where("string is null").select(*key).join(strings, ["host", "family"])
    held, _ = materialize(packed.groupBy(*key).cogroup(looked.groupBy(*key)).applyInArrow(held_in_bucket, HELD), "held")
    least, share = (F.when(F.col("family") == OUTSIDE, REPEATED[OUTSIDE][i]).otherwise(REPEATED[INSIDE][i]) for i in range(2))
    counted = held.groupBy("host", "family", "string").agg(F.sum("n").alias("n")).join(of, ["host", "family"])
    repeated = counted.where((F.col("n") >= least) & (F.col("n") >= share * F.col("of"))).select("host", "family", "string")
    covered = held.where("content is not null").join(repeated, ["host", "family", "string"])
    return materialize(covered.groupBy("host", "family", "content").agg(F.collect_set("string").alias("strings")), "covered")[0]
