"""Near-duplicate texts by Golay keys of SimHash fingerprints, verified by five-word shingles.

A text is the set of the XXH64 values of its SHINGLE-word shingles (of the whole word sequence if it is shorter). Texts
whose sets have a Jaccard similarity of OVER / UNDER or more are linked; a document's component is the smallest id it
reaches over links.

Finding candidates: at this similarity fingerprints of the shingles themselves are too far apart for a few errors a
segment (one changed word changes five shingles). The fingerprint is therefore the bitwise majority over a text's
distinct words, 128 bits long, where such texts differ in some 4 to 20 bits. Its six segments are decoded with the Golay
code as in golay.py; each pair of segments gives keys all x near and near x all. Up to 10 errors leave some pair of
segments with two or less, and meet for certain; more errors meet with high probability (0.995 or better was measured of
pairs at the similarity, see the README). Fingerprints that share a key and differ in at most ERRORS bits are linked to
candidate groups, which span buckets without all pairs of them.

Verifying: shingle sets of a candidate group meet in blocks of about BLOCK, and similarities within a block come from
one matrix product of counts. A group of several blocks has its blocks verified first; then the sets that do not belong
to the group's largest component so far visit the other blocks, if that moves each of the group's sets VISITS times at most
on average. So a large group of copies moves its sets once, and no link within a group is lost.

Where fingerprints are no help, an exact way follows: for fingerprints of buckets of more than HOT_BUCKET, which are not
gathered, and for groups with more visits than that. Two sets at the similarity share one of their first shingles in any
order of all shingles, if each gives as many as the similarity may leave out, and one more. Shingles are ordered from rare
to frequent, so these are few to a set. Sets that share such a shingle are a group of their own and are verified as above;
shingles whose sets are all linked already fall away before a set moves.

Scale: only distinct sets are keyed. What moves besides are numbers, except the sets of groups, once, and those of the
exact way, once a shingle that two components share.

Defined results: a null or empty text has the empty set, and such texts are equal; repeated rows get equal rows; very long
texts are treated like any other; a null id is never the smallest unless all of a component are null; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quatrain.llm.common import map_texts, materialize, text_or_empty
from quatrain.llm.components import connected_components
from quatrain.llm.golay import keyed_rows, link_buckets

SHINGLE, SEED = 5, 42
#: The least similarity as a fraction.
OVER, UNDER = 4, 5
ERRORS = 20
BLOCK = 256
VISITS = 32
HOT_BUCKET = 20_000
LINK = "a long, b long"
COLUMNS = 4096


def words_of(text: str) -> list[bytes]:
    """bytes.lower() changes A-Z only, bytes.split() cuts at the six ASCII blanks."""
    return text.encode("utf-8").lower().split()


def shingle_set(words: list[bytes]) -> np.ndarray:
    """Sorted distinct XXH64 values."""
    import xxhash

    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(words) - SHINGLE + 1].tolist()
    digest = xxhash.xxh64_digest
    hashed = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)])
    return np.unique(np.frombuffer(hashed, ">u8").astype(np.uint64))


def set_key(members: np.ndarray) -> int:
    import xxhash

    return int(np.array([xxhash.xxh64_intdigest(members.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def word_fingerprint(words: list[bytes]) -> bytes:
    """16 bytes: the bitwise majority over distinct words."""
    import xxhash

    distinct = set(words)
    if not distinct:
        return bytes(16)
    digest = xxhash.xxh3_128_digest
    votes = np.frombuffer(b"".join([digest(w, SEED) for w in distinct]), np.uint8).reshape(-1, 16)
    counts = np.zeros(128, np.int64)
    for at in range(0, len(votes), 8192):
        counts += np.unpackbits(votes[at : at + 8192], axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * counts > len(votes)).tobytes()


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted sets: a product of incidence matrices, some columns at a time."""
    if len(left) * len(right) <= 4:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in right] for x in left], np.int64)
    x, y = np.concatenate(left), np.concatenate(right)
    own_x, own_y = np.repeat(np.arange(len(left)), [len(s) for s in left]), np.repeat(np.arange(len(right)), [len(s) for s in right])
    both = np.intersect1d(x, y)
    if left is right:  # a value that only one set has counts for its own size alone, which nobody asks
        values, often = np.unique(x, return_counts=True)
        both = values[often > 1]
    out = np.zeros((len(left), len(right)), np.float32)
    there = []
    for values, own in ((x, own_x), (y, own_y)):
        at = np.minimum(np.searchsorted(both, values), max(0, len(both) - 1))
        hit = both[at] == values if len(both) else np.zeros(len(values), bool)
        order = np.argsort(at[hit], kind="stable")
        there.append((at[hit][order], own[hit][order]))
    for begin in range(0, len(both), COLUMNS):
        grids = []
        for (at, own), n in zip(there, out.shape, strict=True):
            a, b = np.searchsorted(at, [begin, begin + COLUMNS])
            grid = np.zeros((n, COLUMNS), np.float32)
            grid[own[a:b], at[a:b] - begin] = 1
            grids.append(grid)
        out += grids[0] @ grids[1].T
    return out.astype(np.int64)


def alike(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which sets reach the similarity; the diagonal of a block with itself means nothing."""
    both = overlaps(left, right)
    sizes = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :]
    return both * UNDER >= OVER * (sizes - both)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list, list]]:
    """(comp, block, visits, fp, root, members) in order of the first three: a block's own fps, roots and sets, then the
    same of up to BLOCK visitors at a time, and at least once."""
    key, own, guests, gone = None, [], [], False

    def part(rows: list[tuple]) -> tuple[list, list, list]:
        return [r[0] for r in rows], [r[1] for r in rows], [np.frombuffer(r[2], np.uint64) for r in rows]

    for batch in batches:
        for comp, block, visits, fp, root, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (comp, block) != key:
                if key is not None and (guests or not gone):
                    yield part(own), part(guests)
                key, own, guests, gone = (comp, block), [], [], False
            (guests if visits else own).append((fp, root, members))
            if len(guests) == BLOCK:
                yield part(own), part(guests)
                guests, gone = [], True
    if key is not None and (guests or not gone):
        yield part(own), part(guests)


def _pairs(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _links_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that span each block's components."""
    for (fps, _, sets), _ in _blocks(batches):
        near = alike(sets, sets)
        rest, a, b = set(range(len(fps))), [], []
        while rest:
            queue = [rest.pop()]
            while queue and rest:
                x = queue.pop()
                reached = [y for y in np.flatnonzero(near[x]).tolist() if y in rest]
                rest.difference_update(reached)
                queue += reached
                a += [fps[x]] * len(reached)
                b += [fps[y] for y in reached]
        yield _pairs(a, b)


def _links_of_visitors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of visitors to a block's sets of other components, one a component."""
    for (fps, roots, sets), (other_fps, other_roots, others) in _blocks(batches):
        if not fps or not others:
            continue
        near, a, b = alike(others, sets), [], []
        roots = np.array(roots)
        for i, fp in enumerate(other_fps):
            at = np.flatnonzero(near[i] & (roots != other_roots[i]))
            first = at[np.unique(roots[at], return_index=True)[1]].tolist()
            a += [fp] * len(first)
            b += [fps[k] for k in first]
        yield _pairs(a, b)


def _linked(rows: DataFrame, find, name: str) -> DataFrame:
    rows = rows.repartition("comp", "block").sortWithinPartitions("comp", "block", "visits")
    return materialize(rows.mapInArrow(find, LINK), name)[0]


def _in_blocks(nodes: DataFrame, block: int) -> DataFrame:
    """(comp, fp, block, blocks) of nodes (comp, fp)."""
    sizes = nodes.groupBy("comp").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    return nodes.join(sizes, "comp").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))


def _within(sets: DataFrame) -> DataFrame:
    """Links within blocks of sets (comp, block, fp, members)."""
    return _linked(sets.select("comp", "block", F.lit(False).alias("visits"), "fp", F.lit(0).cast("long").alias("root"), "members"), _links_within, "links")


def _rooted(sets: DataFrame, stars: DataFrame) -> DataFrame:
    return sets.join(stars.withColumnRenamed("src", "fp"), "fp", "left").withColumn("root", F.coalesce("dst", "fp")).drop("dst")


def _visits(sets: DataFrame, stars: DataFrame, most: float | None) -> tuple[DataFrame | None, DataFrame | None]:
    """Links of the sets outside their group's largest component to its other blocks, and the groups (comp) that would move
    their sets more than most times (None: no such groups), which have not been visited."""
    large = sets.where("blocks > 1")
    if large.isEmpty():
        return None, None
    rooted, _ = materialize(_rooted(large, stars), "rooted")
    parts = rooted.groupBy("comp", "root").agg(F.count("*").alias("n"), F.first("blocks").alias("b"))
    groups = parts.groupBy("comp").agg(F.max_by("root", F.struct("n", "root")).alias("main"), ((F.sum("n") - F.max("n")) * F.first("b") / F.sum("n")).alias("moves"))
    groups, _ = materialize(groups, "groups")
    over = None if most is None else groups.where(F.col("moves") > most).select("comp")
    rooted = rooted.join(groups if most is None else groups.where(F.col("moves") <= most), "comp")
    own = rooted.select("comp", "block", F.lit(False).alias("visits"), "fp", "root", "members")
    out = rooted.where("root != main").select("comp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("visits"), "fp", "root", "members")
    return _linked(own.union(out), _links_of_visitors, "more"), over


def _first_shingles(sets: DataFrame) -> DataFrame:
    """(fp, shingle): the first of each set, from rare to frequent, of which sets at the similarity share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                members = np.frombuffer(batch.column(1)[i].as_py(), np.int64)
                n = len(members)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch.column(0)[i].as_py(), np.int64)), pa.array(members), pa.array(np.full(n, n, np.int32))], names=["fp", "shingle", "size"])

    each = sets.select("fp", "members").mapInArrow(run, "fp long, shingle long, size int")
    ranked = each.join(each.groupBy("shingle").agg(F.count("*").alias("often")), "shingle")
    # a set's own shingles, as many as its text has
    order = Window.partitionBy("fp").orderBy("often", "shingle")
    needed = F.col("size") - F.floor((F.col("size") * OVER + UNDER - 1) / UNDER) + 1
    return ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= needed).where("often > 1").select("fp", "shingle")


def _exact(sets: DataFrame, links: DataFrame, block: int) -> DataFrame:
    """links and those that span what sets (fp, members) have besides, whatever their fingerprints."""
    stars, _ = connected_components(links)
    keys, _ = materialize(_rooted(_first_shingles(sets), stars), "keys")
    # shingles whose sets belong together already say nothing new
    mixed = keys.groupBy("shingle").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select(F.col("shingle").alias("comp"))
    nodes = keys.select(F.col("shingle").alias("comp"), "fp").join(mixed, "comp", "left_semi")
    placed, _ = materialize(_in_blocks(nodes, block).join(sets, "fp"), "placed")
    links = links.union(_within(placed))
    more, _ = _visits(placed, connected_components(links)[0], None)
    return links if more is None else links.union(more)


def _verified(source: DataFrame, distinct: DataFrame, groups: DataFrame, hot: DataFrame, block: int) -> DataFrame:
    """src and dst as connected_components gives them, of verified links. groups: the same of candidates; hot: (fp) of
    buckets that were not compared."""
    nodes, _ = materialize(groups.select(F.col("src").alias("fp"), F.col("dst").alias("comp")).union(groups.select("dst", "dst").distinct()), "nodes")
    any_hot = not hot.isEmpty()
    if any_hot:
        hot, _ = materialize(hot.distinct(), "hot")
        nodes = nodes.union(hot.join(nodes, "fp", "left_anti").select("fp", F.col("fp").alias("comp")))
    placed = _in_blocks(nodes, block).join(distinct.select(F.col("__fp").alias("fp"), "__hash"), "fp")
    placed = placed.select("__hash", "fp", "comp", "block", "blocks")

    def make():
        return lambda texts: [pa.array([shingle_set(words_of(t)).tobytes() for t in texts], pa.binary())]

    texts = source.withColumn("__hash", F.xxhash64("__body")).join(placed, "__hash").dropDuplicates(["fp"])
    sets, _ = materialize(map_texts(texts, ["fp", "comp", "block", "blocks"], F.col("__body"), make, [T.StructField("members", T.BinaryType(), False)]), "sets")
    links = _within(sets)
    stars, _ = connected_components(links)
    more, over = _visits(sets, stars, VISITS)
    if more is not None:
        links = links.union(more)
    left = sets.join(hot, "fp", "left_semi") if any_hot else None
    if over is not None and not over.isEmpty():
        busy = sets.join(over, "comp", "left_semi")
        left = busy if left is None else left.unionByName(busy).dropDuplicates(["fp"])
    if left is not None:
        left, _ = materialize(left.select("fp", "members"), "left")
        links = _exact(left, links, block)
    elif more is None:
        return stars
    return connected_components(links)[0]


def similar_texts(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] = (), root_col: str | None = None, hot_bucket: int = HOT_BUCKET, block: int = BLOCK
) -> DataFrame:
    """The id, component_id (smallest id reachable) and kept columns; root_col as in golay.near_duplicates."""
    held = ["__id", *(f"__k{i}" for i in range(len(keep)))]
    source = df.select(F.col(id_col).alias("__id"), *[F.col(c).alias(h) for h, c in zip(held[1:], keep, strict=True)], text_or_empty(text_col).alias("__body"))

    def make():
        def work(texts: list[str]) -> list[pa.Array]:
            words = [words_of(t) for t in texts]
            prints = np.frombuffer(b"".join(map(word_fingerprint, words)), ">i8").astype(np.int64).reshape(-1, 2)
            return [pa.array([set_key(shingle_set(w)) for w in words], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1])]

        return work

    fields = [T.StructField(n, T.LongType(), False) for n in ("__fp", "__w0", "__w1")]
    marked, _ = materialize(map_texts(source.withColumn("__hash", F.xxhash64("__body")), [*held, "__hash"], F.col("__body"), make, fields), "fingerprints")
    each = marked.groupBy("__fp").agg(F.min("__id").alias("__least"), F.min("__hash").alias("__hash"), F.min("__w0").alias("w0"), F.min("__w1").alias("w1"))
    distinct, _ = materialize(each, "distinct")
    keys = distinct.select("__fp", "w0", "w1").mapInArrow(keyed_rows, "key int, fp long, w0 long, w1 long").repartition("key").sortWithinPartitions("key")
    links, _ = materialize(keys.mapInArrow(lambda b: link_buckets(b, hot_bucket, ERRORS), LINK).distinct(), "candidates")
    groups, _ = connected_components(links.where("a != b"))
    stars = _verified(source, distinct, groups, links.where("a = b").select(F.col("a").alias("fp")), block)
    rooted = distinct.join(stars.withColumnRenamed("src", "__fp"), "__fp", "left").withColumn("__root", F.coalesce("dst", "__fp"))
    roots = rooted.groupBy("__root").agg(F.min("__least").alias("__component"))
    named = rooted.select("__fp", "__root").join(roots, "__root")
    return marked.join(named, "__fp").select(
        F.col("__id").alias(id_col),
        F.col("__component").alias("component_id"),
        *[F.col(h).alias(c) for h, c in zip(held[1:], keep, strict=True)],
        *([F.col("__root").alias(root_col)] if root_col else []),
    )
