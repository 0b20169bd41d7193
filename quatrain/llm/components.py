"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quatrain.llm.common import discard, materialize


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges (src > dst) with each node's lesser neighbours hung on the least of them."""
    low = edges.groupBy("src").agg(F.min("dst").alias("m"))
    pulled = edges.join(low, "src").where("dst != m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return pulled.union(low.select("src", F.col("m").alias("dst"))).distinct()


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges (src > dst). Minima are aggregated before they are joined, so no
    neighbourhood is ever gathered in one place; hot nodes are left to Spark's skew handling of the joins."""
    both = edges.union(edges.select("dst", "src"))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
    return _small_star(large)


def connected_components(pairs: DataFrame) -> tuple[DataFrame, list[str]]:
    """pairs: columns a, b (long). Gives (src, dst): each linked node but the least of its component, with that least
    node; and the paths of scratch tables that the result still reads. Each round is written to the shared folder."""
    spark = pairs.sparkSession
    start = pairs.where("a != b").select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).distinct()
    # links of many buckets name few centres: hanging those together first leaves about one edge a node
    edges, path = materialize(_small_star(start), "edges")
    mark = None
    while True:
        found = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
        if found["n"] == 0 or (found["n"], found["h"]) == mark:
            return edges, [path]
        mark = (found["n"], found["h"])
        old = path
        edges, path = materialize(_stars(edges), "stars")
        discard(old)
