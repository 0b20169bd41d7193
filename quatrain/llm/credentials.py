"""Secret scans with multipart credential linking.

Base kinds are found by pattern: assign (a secret's name, a sign and a value of 12 or more), access (an access key
identifier of 18 or more) and hex (16 or more hexadecimal digits). Matches of a kind are leftmost and do not overlap; a
match that is too short is dropped after it has used up its signs.

Besides them there are weak parts, which say nothing alone: identifiers (a user, client or account name that is
assigned), short secrets (assigned values of 6 to 11 signs, or a random-looking run of 20 or more that no name
announces) and endpoints (addresses with a scheme, or hosts with a port). Parts are joined as intervals to scopes: a
scope spans SCOPE code points on either side of a strong access identifier or a weak identifier, and holds every part, however
long, that overlaps it. Weak parts are reported only where complementary ones meet in a scope: an identifier with a secret of either strength; endpoints only where both
are there. Base spans stay whatever the linking finds.

Defined results: a null or empty text has no spans (counts 0, SHA-256 of the empty string, spans ""); repeated rows are
scanned each; an empty table gives an empty table; texts, very long ones too, are scanned whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quatrain.llm.common import map_texts, text_or_empty

#: Fixed by the contract of the query.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of fewer signs cannot hold a match
KINDS = ("assign", "access", "hex", "ident", "weak", "endpoint")
NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")

SCOPE = 200
IDENT = re.compile(r"""\b(?:user(?:_?name|_?id)?|login|account(?:_?id)?|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,}+)""", re.IGNORECASE | re.ASCII)
IDENT_NAMES = ("user", "login", "account", "client", "access")
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+")
ENDPOINT = re.compile(r"""\b[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]{3,}+|\b(?:[a-z0-9-]{1,63}\.){1,126}[a-z]{2,63}:\d{2,5}\b|\b(?:\d{1,3}\.){3}\d{1,3}:\d{2,5}\b""")


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(start, kind, end) of the base kinds, and the spans of assignments whose value is too short."""
    spans, short = [], []
    low = text.lower()
    if any(n in low for n in NAMES):
        for m in ASSIGN.finditer(text):
            size = m.end(2) - m.start(2)
            if size >= 12:
                spans.append((m.start(), 0, m.end()))
            elif size >= 6:
                short.append(m.span())
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return spans, short


def looks_random(run: str) -> bool:
    return any(c.isdigit() for c in run) and any(c.islower() for c in run) and any(c.isupper() for c in run) and len(set(run)) >= 12


def linked_spans(text: str, base: list[tuple[int, int, int]], short: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Weak parts that meet complementary parts in a scope."""
    low = text.lower()
    idents = [(m.start(), m.end()) for m in IDENT.finditer(text)] if any(n in low for n in IDENT_NAMES) else []
    anchors = sorted(idents + [(s, e) for s, k, e in base if k == 1])
    if not anchors:
        return []
    taken = sorted((s, e) for s, k, e in base)

    def free(s: int, e: int) -> bool:
        at = bisect_left(taken, (e, 0))
        return at == 0 or taken[at - 1][1] <= s

    weak = sorted(short + [m.span() for m in RANDOM.finditer(text) if free(*m.span()) and looks_random(m[0])])
    strong = sorted((s, e) for s, k, e in base if k != 1)
    ends = [m.span() for m in ENDPOINT.finditer(text)] if "://" in text or ":" in text else []

    def inside(parts: list[tuple[int, int]], low_end: int, high_end: int) -> list[tuple[int, int]]:
        # a part may end far behind its scope, or begin far before it; furthest ends so far come in order
        found, at = [], bisect_left(furthest[id(parts)], low_end)
        while at < len(parts) and parts[at][0] <= high_end:
            if parts[at][1] >= low_end:
                found.append(parts[at])
            at += 1
        return found

    furthest = {id(parts): list(accumulate((e for _, e in parts), max)) for parts in (weak, strong, ends)}

    out: set[tuple[int, int, int]] = set()
    weak_ids = set(idents)
    for s, e in anchors:
        scope = (s - SCOPE, e + SCOPE)
        secrets = [x for x in inside(weak, *scope) if x[1] <= s or x[0] >= e]
        others = [x for x in inside(strong, *scope) if x[1] <= s or x[0] >= e]
        if not secrets and not others:
            continue
        if (s, e) in weak_ids:
            out.add((s, 3, e))
        out |= {(a, 4, b) for a, b in secrets}
        out |= {(a, 5, b) for a, b in inside(ends, *scope)}
    return list(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan_secrets(df: DataFrame, text_col: str = "text", id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Id columns, n_assign, n_access, n_hex, base_sha256 (of the joined base spans) and spans (base and linked)."""

    def make():
        def work(texts: list[str]) -> list[pa.Array]:
            counts: tuple[list[int], ...] = ([], [], [])
            hashes, spans = [], []
            for t in texts:
                base, short = base_spans(t)
                kinds = [k for _, k, _ in base]
                for k, c in enumerate(counts):
                    c.append(kinds.count(k))
                hashes.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + linked_spans(t, base, short)))
            return [*(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(spans, pa.string())]

        return work

    fields = [T.StructField(n, T.LongType(), False) for n in ("n_assign", "n_access", "n_hex")]
    fields += [T.StructField(n, T.StringType(), False) for n in ("base_sha256", "spans")]
    return map_texts(df, list(id_cols), text_or_empty(text_col), make, fields)
