"""Removal of long repeated strings by prefix-free parsing.

Every byte is removed that is covered by a string of LENGTH bytes which also begins anywhere else, in the same text or
in another one; strings lie within one text and are judged on the input.

Triggers and phrases. A rolling hash runs over windows of TRIGGER bytes. Windows whose hash has residue 0 modulo
RESIDUE come first, all others after them; the first window with the least hash in a string of LENGTH bytes is the
string's trigger. It depends on the string alone, so equal strings are cut alike, and every string has one (residues
alone would leave strings without). Triggers cut texts into phrases: a phrase ends with a trigger, and the parse goes on
from that trigger. A string is thus the end of a phrase, up to a trigger, and a piece of the parse from there.

Dictionary. All strings of one trigger occurrence together are an entry: their hull is what they cover. Entries are
compared in the dictionary of distinct hulls, not at positions of the corpus:

* a trigger that occurs once ends no repeated string: the entry is dropped;
* a hull that occurs twice is covered as a whole, at all its occurrences;
* what is left are distinct hulls around equal triggers, one occurrence of each.

Order. For the hulls of one trigger two arrays are sorted, with the common lengths of neighbours: the dictionary's, of
phrase ends read from the trigger backwards (one order for suffixes of all lengths), and the parse's, of what follows
from the trigger on. A string that begins d bytes before the trigger has as its place in the corpus order the class of
its phrase end (neighbours with d bytes in common) and then the class of its parse suffix (LENGTH - d in common).
Strings that share a place are equal, and bytes are compared, not hashes.

Scale: copies of a text fall together first and enter once. Aggregates have partial aggregation; joins have one row a key
on one side, so Spark can split hot keys. A group is sorted in one task only if it has at most HOT distinct hulls;
hulls of a hotter trigger are taken apart into single strings, which are counted by 128 bits. Texts are hashed in
pieces of PIECE bytes that overlap by LENGTH - 1, so memory does not grow with the length of a text. Each phase is
written to the shared folder.

Defined results: a null or empty text has no bytes and keeps none (SHA-256 of nothing); texts shorter than LENGTH keep
all; repeated rows and copies are copies of each other and lose all from LENGTH bytes on; very long texts are treated like
any other; null ids stay null; an empty table gives an empty table; other columns are not read unless they are to be kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quatrain.llm.common import discard, materialize, text_or_empty

LENGTH = 200
TRIGGER = 64
RESIDUE = 128
#: Offsets that a trigger can have in a string.
OFFSETS = LENGTH - TRIGGER + 1
#: Bytes of a hull before and from the trigger on.
AHEAD, BEHIND = OFFSETS - 1, LENGTH
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Texts are hashed in batches of about so many bytes, long ones in overlapping pieces.
PIECE = 1 << 18
#: Low bits of a window's sort key that hold its place in the batch, which settles ties.
PLACE_BITS = 21
#: Distinct hulls of one trigger that one task sorts.
HOT = 20_000
SORTED = 4096


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any spans of a byte string: sums of bytes' random numbers times powers of an odd base, modulo 2**64,
    brought to the span's start by the inverse base."""

    def __init__(self, base: int):
        self.table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(base ^ 0x5555))
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.empty(0, np.uint64)

    @staticmethod
    def _powers(n: int, base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def sums(self, data: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        if len(self.up) < n:
            self.up, self.down = self._powers(n, self.base), self._powers(n, self.inverse)
        out = np.zeros(n, np.uint64)
        np.cumsum(self.table[data] * self.up[: n - 1], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start])


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each width neighbours, from running minima of blocks in both directions."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def find_triggers(rolling: Rolling, sums: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Triggers of texts that stand in a row (bounds: where they begin, and the end): places, texts, least and greatest
    offset of the strings whose trigger they are, and window hashes."""
    size = int(bounds[-1])
    windows = size - TRIGGER + 1
    hashed = mix((sums[TRIGGER:] - sums[:windows]) * rolling.down[:windows])
    low = np.uint64((1 << PLACE_BITS) - 1)
    key = (hashed >> np.uint64(1)) & ~low
    key |= np.arange(windows, dtype=np.uint64)
    key |= (hashed % np.uint64(RESIDUE) != 0).astype(np.uint64) << np.uint64(63)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: size - LENGTH + 1]
    string = np.arange(size - LENGTH + 1)
    inside = string + LENGTH <= bounds[text + 1]
    owner = (_sliding_least(key, OFFSETS) & low).astype(np.int64)
    string, owner, text = string[inside], owner[inside], text[inside]
    begins = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])])) if len(string) else np.empty(0, np.int64)
    ends = np.append(begins[1:], len(string)) - 1
    at = owner[begins]
    return at, text[begins], at - string[ends], at - string[begins], hashed[at]


def pieces(sizes: list[int]) -> Iterator[list[tuple[int, int, int]]]:
    """Batches of (text, begin, end) of about PIECE bytes: short texts together, long ones in overlapping pieces."""
    held, total = [], 0
    for i, n in enumerate(sizes):
        for a in range(0, max(1, n - LENGTH + 1), PIECE - LENGTH + 1):
            b = min(n, a + PIECE)
            if held and total + b - a > PIECE:
                yield held
                held, total = [], 0
            held.append((i, a, b))
            total += b - a
    if held:
        yield held


class Parser:
    def __init__(self):
        self.rollings = [Rolling(b) for b in BASES]

    def entries(self, bodies: list[bytes]) -> tuple[np.ndarray, ...]:
        """text, place, least, most, core and hull of each trigger of the bodies (of LENGTH bytes or more together)."""
        bounds = np.cumsum([0] + [len(b) for b in bodies])
        data = np.frombuffer(b"".join(bodies), np.uint8)
        sums = [r.sums(data) for r in self.rollings]
        at, text, least, most, core = find_triggers(self.rollings[0], sums[0], bounds)
        hull = self.rollings[1].spans(sums[1], at - most, at - least + LENGTH)
        hull = mix(hull ^ (least << 10 | most).astype(np.uint64))  # hulls of equal bytes and other offsets are others
        return text, at - bounds[text], least, most, core.view(np.int64), hull.view(np.int64)


ENTRY = "rid long, rid2 int, at int, least short, most short, core long, hull long"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, rid2, body) to entries."""
    parser = Parser()
    for batch in batches:
        rids, rids2, bodies = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        for part in pieces([len(b.as_buffer()) for b in bodies]):
            text, at, least, most, core, hull = parser.entries([memoryview(bodies[i].as_buffer())[a:b] for i, a, b in part])
            own = np.array([i for i, _, _ in part])[text]
            at = at + np.array([a for _, a, _ in part])[text]
            made = [rids[own], rids2[own], at.astype(np.int32), least.astype(np.int16), most.astype(np.int16), core, hull]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=[f.split()[0] for f in ENTRY.split(", ")])


CONTEXT = "core long, rid long, rid2 int, at int, least short, most short, n long, context binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, rid2, body, list of core, at, least, most, n) to hulls with their bytes, at the same places around the
    trigger; bytes that are not the hull's are zero."""
    names = [f.split()[0] for f in CONTEXT.split(", ")]
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            bodies, many = part.column(2), part.column(3).value_lengths().to_numpy()
            columns = [part.column(3).flatten().field(k) for k in range(5)]
            own = np.repeat(np.arange(part.num_rows), many)
            views = [memoryview(b.as_buffer()) for b in bodies]
            found = [
                b"".join((bytes(AHEAD - most), views[i][at - most : at - least + LENGTH], bytes(least)))
                for i, at, least, most in zip(own.tolist(), *(c.to_pylist() for c in columns[1:4]), strict=True)
            ]
            made = [columns[0], part.column(0).take(pa.array(own)), part.column(1).take(pa.array(own)), *columns[1:], pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(made, names=names)


def _sorted_with_common(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by group and bytes; and for each place in it the bytes in common with the row before, -1 where
    a group begins."""
    n, width = rows.shape
    keyed = np.concatenate([group.astype(">u4").view(np.uint8).reshape(n, 4), rows], axis=1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"S{width + 4}").ravel(), kind="stable")
    common = np.full(n, -1, np.int64)
    a, b = rows[order[1:]], rows[order[:-1]]
    differ = a != b
    common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common[1:][group[order[1:]] != group[order[:-1]]] = -1
    return order, common


def repeated_offsets(context: np.ndarray, group: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each hull (rows of AHEAD + BEHIND bytes) the least and greatest offset of its strings that another hull of its
    group has as well; where there is none, the least is greater than the greatest."""
    n = len(context)
    ends, ends_common = _sorted_with_common(context[:, :AHEAD][:, ::-1], group)
    parse, parse_common = _sorted_with_common(context[:, AHEAD:], group)
    end_class, parse_class = np.empty(n, np.int64), np.empty(n, np.int64)
    low, high = np.full(n, OFFSETS), np.full(n, -1)
    for d in range(int(least.min(initial=0)), int(most.max(initial=-1)) + 1):
        here = np.flatnonzero((least <= d) & (d <= most))
        if len(here) < 2:
            continue
        end_class[ends] = np.cumsum(ends_common < d)
        parse_class[parse] = np.cumsum(parse_common < LENGTH - d)
        place = end_class[here] * (n + 1) + parse_class[here]
        order = np.argsort(place)
        twin = place[order[1:]] == place[order[:-1]]
        same = here[order[np.concatenate([[False], twin]) | np.concatenate([twin, [False]])]]
        low[same] = np.minimum(low[same], d)
        high[same] = np.maximum(high[same], d)
    return low, high


COVERED = "rid long, rid2 int, begin int, end int"


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts in core order to covered spans; whole groups go through the arrays, many at a time."""

    def covered(columns: list) -> pa.RecordBatch:
        core, rid, rid2, at, least, most, n = columns[:7]
        context = np.frombuffer(b"".join(columns[7]), np.uint8).reshape(len(core), AHEAD + BEHIND)
        group = np.cumsum(np.concatenate([[0], core[1:] != core[:-1]]))
        low, high = repeated_offsets(context, group, least.astype(np.int64), most.astype(np.int64))
        own = np.flatnonzero((low <= high) & (n == 1))  # hulls that occur more often are covered already
        made = [rid[own], rid2[own], (at[own] - high[own]).astype(np.int32), (at[own] - low[own] + LENGTH).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["rid", "rid2", "begin", "end"])

    held: list | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [batch.column(k).to_numpy() for k in range(7)] + [batch.column(7).to_pylist()]
        held = new if held is None else [np.concatenate([x, y]) for x, y in zip(held[:7], new[:7], strict=True)] + [held[7] + new[7]]
        cut = int(np.searchsorted(held[0], held[0][-1]))
        if cut >= SORTED:
            yield covered([x[:cut] for x in held])
            held = [x[cut:] for x in held]
    if held is not None and len(held[0]):
        yield covered(held)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of hot triggers to single strings: 128 bits, how often, and where."""
    for batch in batches:
        rows: tuple[list, ...] = ([], [], [], [], [], [])
        for rid, rid2, at, least, most, n, context in zip(*(batch.column(k).to_pylist() for k in range(1, 8)), strict=True):
            for d in range(least, most + 1):
                h = hashlib.blake2b(context[AHEAD - d : AHEAD - d + LENGTH], digest_size=16).digest()
                for column, x in zip(rows, (int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True), n, rid, rid2, at - d), strict=True):
                    column.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=["s1", "s2", "n", "rid", "rid2", "begin"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs that the spans cover."""
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def _cut(batches: Iterator[pa.RecordBatch], with_kept: bool) -> Iterator[pa.RecordBatch]:
    """(id, body, spans) to results; spans may be null."""
    for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
        n_bytes, n_removed, n_spans, digest, left = [], [], [], [], []
        for body, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            runs = merged([(s["begin"], s["end"]) for s in spans or ()])
            ends = [0] + [e for _, e in runs]
            rest = b"".join(body[a:b] for a, b in zip(ends, [b for b, _ in runs] + [len(body)], strict=True)) if runs else body
            n_bytes.append(len(body))
            n_removed.append(len(body) - len(rest))
            n_spans.append(len(runs))
            digest.append(hashlib.sha256(rest).hexdigest())
            if with_kept:
                left.append(rest)
        made = [pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)] + [pa.array(digest, pa.string())]
        made += [pa.array(left, pa.binary())] if with_kept else []
        yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 1 + len(made)])


def covered_spans(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """(rid, rid2, begin, end) of strings that occur twice or more. texts: distinct, with rid, rid2, body and copies, the
    number of rows that have the text; spans of texts with more than one copy are left out."""
    spark = texts.sparkSession
    key = ["rid", "rid2"]
    entries, entries_path = materialize(texts.select(*key, "body").mapInArrow(_parse, ENTRY), "entries")
    cores, cores_path = materialize(entries.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), "cores")
    met, met_path = materialize(entries.join(cores, "core"), "met")
    discard(entries_path, cores_path)
    one = F.min(F.struct(*key, "at", "least", "most")).alias("one")
    hulls, hulls_path = materialize(met.groupBy("core", "hull").agg(F.count("*").alias("n"), one), "hulls")
    often, often_path = materialize(hulls.where("n > 1").select("core", "hull"), "often")
    whole = met.join(often, ["core", "hull"]).select(*key, (F.col("at") - F.col("most")).alias("begin"), (F.col("at") - F.col("least") + LENGTH).alias("end"))
    whole, whole_path = materialize(whole, "whole")
    discard(met_path, often_path)
    mixed, mixed_path = materialize(hulls.groupBy("core").agg(F.count("*").alias("hulls")).where("hulls > 1"), "mixed")
    open_hulls = hulls.join(mixed, "core").select("one.rid", "one.rid2", F.struct("core", "one.at", "one.least", "one.most", "n").alias("x"), "hulls")
    listed = open_hulls.groupBy(*key).agg(F.collect_list("x").alias("asked"))
    asked = texts.join(listed, key).select(*key, "body", "asked").mapInArrow(_contexts, CONTEXT)
    contexts, _ = materialize(asked, "contexts")
    out = [whole]
    too_many, _ = materialize(mixed.where(F.col("hulls") > hot).select("core"), "hot")
    some = not too_many.isEmpty()
    cool = contexts.join(too_many, "core", "left_anti") if some else contexts
    out.append(cool.repartition("core").sortWithinPartitions("core").mapInArrow(_in_order, COVERED))
    if some:
        single, _ = materialize(contexts.join(too_many, "core", "left_semi").mapInArrow(_strings, "s1 long, s2 long, n long, rid long, rid2 int, begin int"), "single")
        twice, _ = materialize(single.groupBy("s1", "s2").agg(F.count("*").alias("m")).where("m > 1").select("s1", "s2"), "twice")
        out.append(single.where("n = 1").join(twice, ["s1", "s2"]).select(*key, "begin", (F.col("begin") + LENGTH).cast("int").alias("end")))
    found = out[0]
    for o in out[1:]:
        found = found.unionByName(o)
    found, _ = materialize(found, "spans")
    discard(hulls_path, whole_path, mixed_path)
    return found


def remove_repeats(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", with_kept: bool = False, hot: int = HOT) -> DataFrame:
    """The id, n_bytes, n_removed, n_spans and kept_sha256; with_kept adds the bytes that are left (kept)."""
    source = df.select(F.col(id_col).alias("id"), F.encode(text_or_empty(text_col), "UTF-8").alias("body"))
    short = source.where(F.octet_length("body") < LENGTH)
    long = source.where(F.octet_length("body") >= LENGTH).select("id", F.xxhash64("body").alias("rid"), F.hash("body").alias("rid2"), "body")
    # copies of a task fall together before the exchange; id is the only one's id where copies is 1
    texts = long.groupBy("rid", "rid2").agg(F.first("body").alias("body"), F.count("*").alias("copies"), F.first("id").alias("id"))
    texts, _ = materialize(texts, "texts")
    # every string of a text with copies occurs twice: the text goes whole, and counts once for others
    copied, _ = materialize(texts.where("copies > 1").select("rid", "rid2"), "copied")
    spans = covered_spans(texts, hot).groupBy("rid", "rid2").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    results = T.StructType(
        [T.StructField("id", source.schema["id"].dataType)]
        + [T.StructField(n, T.LongType(), False) for n in ("n_bytes", "n_removed", "n_spans")]
        + [T.StructField("kept_sha256", T.StringType(), False)]
        + ([T.StructField("kept", T.BinaryType(), False)] if with_kept else [])
    )
    alone = texts.where("copies = 1").join(spans, ["rid", "rid2"], "left").select("id", "body", "spans").mapInArrow(lambda b: _cut(b, with_kept), results)
    size, none = F.octet_length("body").cast("long").alias("n_bytes"), F.lit(0).cast("long")
    kept = short.select("id", size, none.alias("n_removed"), none.alias("n_spans"), F.sha2("body", 256).alias("kept_sha256"), *([F.col("body").alias("kept")] if with_kept else []))
    nothing = F.lit(b"")
    gone = long.select("id", "rid", "rid2", size).join(copied, ["rid", "rid2"], "left_semi")
    gone = gone.select("id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(nothing, 256).alias("kept_sha256"), *([nothing.alias("kept")] if with_kept else []))
    out = kept.unionByName(alone).unionByName(gone)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_kept else []))
