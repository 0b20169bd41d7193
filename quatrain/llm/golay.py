"""SimHash near-duplicates with Golay-code fuzzy hashing.

A text's fingerprint is the bitwise majority of the XXH64 values of its word shingles. Fingerprints that differ in at
most four bits are linked, and a document's component is the smallest id it reaches over links.

Finding links: the 64 bits are three segments of 22, 21 and 21 bits. Four errors leave at most two in some pair of
segments. Each segment, padded to 23 bits, is decoded with the perfect (23, 12) Golay code: near is the one codeword
within three bits, all are the codewords within four (one, or six). Words two bits apart share one of all, because a
word between them has a codeword within three; for words one bit apart, near of one is among all of the other. A pair of
segments therefore gives the keys all x near and near x all, about ten: they meet for error counts (2,0) and (0,2) where
the other segment is equal, and for (1,1) in near of one times near of the other. Fingerprints that share a key are
verified.

Scale: copies fall together before any join, since only distinct fingerprints are keyed. A bucket is read in key order
and links only what spans it: what has been reached is compared with what has not, not all pairs. A bucket of more than
HOT_BUCKET fingerprints is not gathered; its fingerprints take another exact way, in which each gives all words within
two bits and those that share a word are linked to the least of them (they are within four by construction).

Defined results: a null or empty text has fingerprint zero and is linked like any other; repeated rows get equal rows; a
null id is never the smallest unless all of a component are null; very long texts are fingerprinted whole; an empty table
gives an empty table.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quatrain.llm.common import map_texts, materialize, text_or_empty
from quatrain.llm.components import connected_components

#: Fixed by the contract of the query.
SHINGLE, SEED, ERRORS = 4, 42, 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
GENERATOR = 0b110001110101
HOT_BUCKET = 20_000
SMALL_BUCKET = 8


def fingerprint(text: str) -> bytes:
    """Eight bytes, highest first. bytes.lower() changes A-Z only, bytes.split() cuts at the six ASCII blanks."""
    import xxhash

    words = text.encode("utf-8").lower().split()
    if not words:
        return bytes(8)
    if len(words) < SHINGLE:
        return xxhash.xxh64_digest(b" ".join(words), SEED)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(words) - SHINGLE + 1].tolist()
    digest = xxhash.xxh64_digest
    hashed = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)])
    counts = np.zeros(64, np.int64)
    votes = np.frombuffer(hashed, np.uint8).reshape(-1, 8)
    for at in range(0, len(votes), 8192):
        counts += np.unpackbits(votes[at : at + 8192], axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * counts > len(votes)).tobytes()


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the 12 high bits, and by syndrome the error words that lead to all codewords within four bits: the
    nearest first, five more or -1."""
    rest = np.zeros(4096, np.int64)
    for high in range(4096):
        r = high << 11
        for bit in range(22, 10, -1):
            if r >> bit & 1:
                r ^= GENERATOR << (bit - 11)
        rest[high] = r
    errors = np.full((2048, 6), -1, np.int64)
    filled = np.zeros(2048, np.int64)
    for weight in range(5):
        for places in itertools.combinations(range(23), weight):
            e = sum(1 << p for p in places)
            s = (e & 2047) ^ int(rest[e >> 11])
            errors[s, filled[s]] = e
            filled[s] += 1
    return rest, errors


def near_indices(words: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(n, 6) codeword indices within four bits of 23-bit words, nearest first, -1 for none."""
    rest, errors = tables
    e = errors[(words & 2047) ^ rest[words >> 11]]
    return np.where(e < 0, -1, (words[:, None] ^ e) >> 11)


def fuzzy_keys(words: list[np.ndarray], tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the rows they belong to, of fingerprints that are one or more 64-bit words."""
    index = []
    for word in words:
        bits = word.view(np.uint64)
        index += [near_indices(((bits >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64), tables) for at, n in SEGMENTS]
    keys, owners = [], []
    for pair, (a, b) in enumerate(itertools.combinations(index, 2)):
        joint = [(a[:, k], b[:, 0]) for k in range(6)] + [(a[:, 0], b[:, k]) for k in range(1, 6)]
        for left, right in joint:
            there = np.flatnonzero((left >= 0) & (right >= 0))
            keys.append(pair << 24 | left[there] << 12 | right[there])
            owners.append(there)
    return np.concatenate(keys), np.concatenate(owners)


def keyed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, words of the fingerprint) to (key, fp, words); without words fp itself is the fingerprint."""
    tables = golay_tables()
    for batch in batches:
        for at in range(0, batch.num_rows, 10_000):
            columns = [c.to_numpy() for c in batch.slice(at, 10_000).columns]
            keys, owners = fuzzy_keys(columns[1:] or columns, tables)
            made = [keys.astype(np.int32), *(c[owners] for c in columns)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["key", "fp", *(f"w{i}" for i in range(len(columns) - 1))])


def _apart(words: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words ^ x).sum(axis=-1, dtype=np.int64)


def _spanning(values: np.ndarray, words: np.ndarray, errors: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A bucket's components as stars around their least values, which are much the same in all buckets that they share:
    each reached fingerprint is compared with those not reached yet."""
    left, right = [], []
    rest = np.arange(len(values))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        found = [np.array(queue)]
        while queue and len(rest):
            x = queue.pop()
            close = _apart(words[rest], words[x]) <= errors
            if close.any():
                reached = rest[close]
                found.append(reached)
                queue += list(reached)
                rest = rest[~close]
        if len(found) > 1:
            members = values[np.concatenate(found)]
            least = members.min()
            left.append(members[members != least])
            right.append(np.full(len(left[-1]), least))
    return left, right


def link_buckets(batches: Iterator[pa.RecordBatch], hot_bucket: int, errors: int = ERRORS) -> Iterator[pa.RecordBatch]:
    """From (key, fp, words) in key order: rows (a, b) of links. Fingerprints of hot buckets come as (fp, fp): they are not
    compared here, and need another way."""
    hot_key = None

    def found(columns: list[np.ndarray]) -> pa.RecordBatch | None:
        keys, values = columns[:2]
        words = np.stack([c.view(np.uint64) for c in (columns[2:] or [values])], axis=1)
        left, right = [], []
        if len(keys) > 1:
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(keys)]]))
            big = sizes > SMALL_BUCKET
            for s, n in zip(starts[big].tolist(), sizes[big].tolist(), strict=True):
                a, b = _spanning(values[s : s + n], words[s : s + n], errors)
                left += a
                right += b
            small = np.repeat(~big, sizes)
            k, v, w = keys[small], values[small], words[small]
            for step in range(1, int(sizes[~big].max(initial=1))):
                at = np.flatnonzero(k[:-step] == k[step:])
                if not len(at):
                    break
                at = at[_apart(w[at], w[at + step]) <= errors]
                left.append(v[at])
                right.append(v[at + step])
        if not sum(map(len, left)):
            return None
        pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def hot(values: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values), pa.array(values)], names=["a", "b"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        new = [c.to_numpy() for c in batch.columns]
        if hot_key is not None:
            same = new[0] == hot_key
            if same.any():
                yield hot(new[1][same])
                new = [c[~same] for c in new]
            if not len(new[0]):
                continue
            hot_key = None
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        if not len(held[0]):
            continue
        last = held[0][-1]
        cut = int(np.searchsorted(held[0], last))  # keys come in order
        made = found([c[:cut] for c in held])
        if made is not None:
            yield made
        held = [c[cut:] for c in held]
        if len(held[0]) > hot_bucket:
            yield hot(held[1])
            hot_key, held = last, None
    made = found(held) if held is not None else None
    if made is not None:
        yield made


def _links_of_hot(hot: DataFrame) -> DataFrame:
    """Links of fingerprints from hot buckets, exact without buckets: those that share a word within two bits."""
    masks = [0] + [1 << i for i in range(64)] + [1 << i | 1 << j for i, j in itertools.combinations(range(64), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    words = hot.select("fp", F.explode(F.transform(F.lit(signed), lambda m: F.col("fp").bitwiseXOR(m))).alias("word"))
    least = words.groupBy("word").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least != most")
    return words.join(least, "word").where("fp != least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()


def link_fingerprints(fps: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """fps: distinct long column fp. Gives pairs (a, b) of linked fingerprints that span every component."""
    keys = fps.mapInArrow(keyed_rows, "key int, fp long").repartition("key").sortWithinPartitions("key")
    found, _ = materialize(keys.mapInArrow(lambda b: link_buckets(b, hot_bucket), "a long, b long").distinct(), "links")
    hot = found.where("a = b").select(F.col("a").alias("fp"))
    if hot.isEmpty():
        return found
    return found.where("a != b").union(_links_of_hot(hot))


def near_duplicates(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] = (), hot_bucket: int = HOT_BUCKET, root_col: str | None = None
) -> DataFrame:
    """The id, fingerprint (16 hexadecimal digits), component_id (smallest id reachable) and kept columns; root_col adds
    a number that tells components apart even where all ids are null."""

    def make():
        return lambda texts: [pa.array(np.frombuffer(b"".join(map(fingerprint, texts)), ">i8").astype(np.int64))]

    source = df.select(F.col(id_col).alias("__id"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], text_or_empty(text_col).alias("__body"))
    held = ["__id", *(f"__k{i}" for i in range(len(keep)))]
    marked, _ = materialize(map_texts(source, held, F.col("__body"), make, [T.StructField("__fp", T.LongType(), False)]), "fingerprints")
    each = marked.groupBy("__fp").agg(F.min("__id").alias("__least"))
    distinct, _ = materialize(each, "distinct")
    stars, _ = connected_components(link_fingerprints(distinct.select(F.col("__fp").alias("fp")), hot_bucket))
    rooted = distinct.join(stars.withColumnRenamed("src", "__fp"), "__fp", "left").withColumn("__root", F.coalesce("dst", "__fp"))
    roots = rooted.groupBy("__root").agg(F.min("__least").alias("__component"))
    named = rooted.select("__fp", "__root").join(roots, "__root")
    return marked.join(named, "__fp").select(
        F.col("__id").alias(id_col),
        F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"),
        F.col("__component").alias("component_id"),
        *[F.col(h).alias(c) for h, c in zip(held[1:], keep, strict=True)],
        *([F.col("__root").alias(root_col)] if root_col else []),
    )


def one_of_each(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", columns: tuple[str, ...] | None = None, find: Callable[..., DataFrame] = near_duplicates) -> DataFrame:
    """One row of each component that find gives: the one with the component's id (of rows that repeat the id, the one
    whose text hash is least). Components are found without the texts, which then move once."""
    from pyspark.sql import Window

    named = df.select(F.col(id_col).alias("__id"), F.xxhash64(text_or_empty(text_col)).alias("__version"), F.col(text_col).alias("__text"))
    groups = find(named, "__text", "__id", ("__version",), root_col="root").where(F.col("__id").eqNullSafe(F.col("component_id")))
    # only rows that repeat an id meet here
    first = Window.partitionBy("root").orderBy("__version")
    chosen = groups.withColumn("n", F.row_number().over(first)).where("n = 1")
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    chosen = chosen.select(key("__id").alias("__key"), "__version")
    columns = tuple(columns or df.columns)
    rows = df.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(columns)], key(id_col).alias("__key"), F.xxhash64(text_or_empty(text_col)).alias("__version"))
    kept = rows.join(chosen, ["__key", "__version"]).dropDuplicates(["__key", "__version"])
    return kept.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(columns)])
