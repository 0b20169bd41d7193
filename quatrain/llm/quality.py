"""Quality rules with robust multivariate outliers, in DataFrame operations only.

Base rules count words, signs, repeated lines and repeated word windows of every whole text. Texts that pass them get a
vector of four transformed statistics: log mean word length, and the logs of signs, repeated lines and repeated words
per 100. For each language and source a minimum-covariance-determinant estimate is made: from the medians and median
deviations, concentration steps take the mean and covariance of the H_SHARE of rows that lie nearest under the estimate
before, which never raises the determinant. A text is rejected if its squared Mahalanobis distance under the last
estimate passes CUTOFF. Every coordinate's variance is raised by a floor, so groups in which nearly all texts have a
statistic of zero do not reject texts for a trace of it.

Scale: rows are never gathered by group. Medians and nearest shares come from counts over a fixed grid, and moments are
partial sums by cell of that grid, so a source with a third of all rows sends a few thousand rows a task. Vectors are a
table of their own, five columns wide, that each step reads once. Groups with fewer than MIN_GROUP texts pool with the small
groups of their language, then of all languages. Estimates are broadcast only if there are at most BROADCAST_GROUPS of them,
and joined otherwise. Their factors are columns, so plans stay small on the driver whatever the input's size.

Defined results: a null or empty text has no words and fails the base rules; null languages or sources count as empty
strings; repeated rows count each and get equal rows; very long texts are counted whole; groups too small for an estimate
of their own are judged by their pool, and kept if no text of it passes the base rules; an empty table gives an empty table. Windows are compared by
64-bit hashes within a text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quatrain.llm.common import discard, materialize, text_or_empty

#: Fixed by the contract of the query.
MIN_WORDS, WINDOW, MOST_REPEATED = 10, 5, 20
SYMBOLS = "#*$%&|<>"

H_SHARE = 0.75
STEPS = 3
#: The chi-square distribution with four degrees of freedom passes this once in twenty million times.
CUTOFF = 40.0
#: Standard deviations by which each coordinate is blurred.
FLOORS = (0.12, 0.5, 1.0, 1.0)
MIN_GROUP = 50
BROADCAST_GROUPS = 20_000
GRID = 128

DIMS = range(4)
BLANK = r"[\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated_words(windows: Column) -> Column:
    """Words in windows that are found twice or more: the windows' places by sorted hash, then the union of spans."""

    def places(s: Column) -> Column:
        n = F.size(s)

        def place(j: Column) -> Column:
            own = F.get(s, j)["h"]
            twin = ((j > 0) & (F.get(s, j - 1)["h"] == own)) | ((j < n - 1) & (F.get(s, j + 1)["h"] == own))
            return F.when(twin, F.get(s, j)["i"])

        return F.filter(F.transform(F.sequence(F.lit(0), n - 1), place), lambda i: i.isNotNull())

    paired = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    covered = F.aggregate(
        F.sort_array(_let(paired, places)),
        start,
        lambda acc, i: F.struct((acc["n"] + (i + WINDOW - F.greatest(i, acc["upto"]))).cast("long").alias("n"), (i + WINDOW).alias("upto")),
        lambda acc: acc["n"],
    )
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(covered)


def text_statistics(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns and n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words."""
    text = df.select(*keep, text_or_empty(text_col).alias("__t"))
    cut = text.select(
        *keep,
        F.array_remove(F.split("__t", BLANK), "").alias("__w"),
        F.length(F.regexp_replace("__t", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__l"),
    )
    counted = cut.select(
        *keep,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("__w") >= WINDOW,
            _let(
                F.transform("__w", lambda w: F.xxhash64(w)),
                lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])),
            ),
        )
        .otherwise(F.array().cast("array<long>"))
        .alias("__h"),
    )
    return counted.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", _repeated_words(F.col("__h")).alias("n_repeat_words"))


def _vector() -> list[Column]:
    share = lambda part, whole: F.log1p(100.0 * F.col(part) / F.greatest(F.col(whole), F.lit(1)))
    return [
        F.log((F.col("word_chars") + 1.0) / F.greatest(F.col("n_words"), F.lit(1))),
        share("n_symbols", "n_words"),
        share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"),
    ]


def _attach(df: DataFrame, stats: DataFrame, few: bool, on: list[str], how: str = "inner") -> DataFrame:
    """Join per-group numbers that stand in a table of their own to rows; few of them are broadcast."""
    return df.join(F.broadcast(stats) if few else stats, on, how)


def _placed(cells: DataFrame, by: list[str]) -> DataFrame:
    """Of cells c with n rows each: upto, the rows up to the cell, and all, those of all cells."""
    running = Window.partitionBy(*by).orderBy("c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = running.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return cells.select("*", F.sum("n").over(running).alias("upto"), F.sum("n").over(whole).alias("all"))


def _grid_quantiles(df: DataFrame, by: list[str], values: dict[str, Column], q: float) -> DataFrame:
    """Per by the upper edge of the grid cell that holds the q-quantile of each value; exact counts, fixed grid."""
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.ceil(v * GRID).alias("c")) for k, v in values.items()])).alias("x"))
    cells = long.groupBy(*by, "x.k", "x.c").agg(F.count("*").alias("n"))
    beyond = _placed(cells, [*by, "k"]).where(F.col("upto") >= q * F.col("all"))
    return beyond.groupBy(*by).agg(*[(F.min(F.when(F.col("k") == k, F.col("c"))) / F.lit(GRID)).alias(k) for k in values])


def _consistency() -> float:
    """What the covariance of the nearest H_SHARE of a normal sample in four dimensions has to be multiplied by."""
    below, above = 0.0, 100.0
    for _ in range(200):
        x = (below + above) / 2
        below, above = (x, above) if 1 - math.exp(-x / 2) * (1 + x / 2) < H_SHARE else (below, x)
    return H_SHARE / (1 - math.exp(-x / 2) * (1 + x / 2 + x * x / 8))


def _factored(model: DataFrame) -> DataFrame:
    """__g, m0..m3 and the Cholesky factor l00..l33 of the covariance s00..s33, an entry from those before it, which stand
    in columns: written out in the s, the last entry alone would have hundreds of terms."""

    def rest(i: int, j: int) -> Column:
        out = F.col(f"s{j}{i}")
        for k in range(j):
            out = out - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        return out

    for j in DIMS:
        model = model.withColumn(f"l{j}{j}", F.sqrt(F.greatest(rest(j, j), F.lit(FLOORS[j] ** 2 * 1e-3))))
        if below := range(j + 1, len(DIMS)):
            model = model.withColumns({f"l{i}{j}": rest(i, j) / F.col(f"l{j}{j}") for i in below})
    return model.select("__g", *[f"m{i}" for i in DIMS], *[f"l{i}{j}" for i in DIMS for j in range(i + 1)])


def _distance() -> Column:
    """Squared Mahalanobis distance of v0..v3 from m0..m3 under the covariance of which l00..l33 is the Cholesky factor."""
    solved: list[Column] = []
    for i in DIMS:
        rest = F.col(f"v{i}") - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * solved[k]
        solved.append(rest / F.col(f"l{i}{i}"))
    return sum((x * x for x in solved[1:]), solved[0] * solved[0])


def _estimates(vectors: DataFrame) -> tuple[DataFrame, bool]:
    """Per __g: m0..m3 and l00..l33 of the minimum-covariance-determinant estimate, and whether they are few enough to be
    broadcast. vectors: __g, v0..v3, a table that is read once for the medians, the deviations and each step."""
    names = [f"v{i}" for i in DIMS]
    middle = [f"m{i}" for i in DIMS]
    medians, at = materialize(_grid_quantiles(vectors, ["__g"], {m: F.col(n) for m, n in zip(middle, names, strict=True)}, 0.5), "medians")
    few = medians.count() <= BROADCAST_GROUPS
    centred = _attach(vectors, medians, few, ["__g"])
    spreads = _grid_quantiles(centred, ["__g", *middle], {f"d{i}": F.abs(F.col(n) - F.col(f"m{i}")) for i, n in enumerate(names)}, 0.5)
    model = spreads.select("__g", *middle, *[(F.pow(1.4826 * F.col(f"d{j}"), 2) + FLOORS[j] ** 2 if i == j else F.lit(0.0)).alias(f"s{i}{j}") for i in DIMS for j in range(i, 4)])
    scale = _consistency()
    off = [F.col(n) - F.col(m) for m, n in zip(middle, names, strict=True)]
    moments = {f"a{i}": off[i] for i in DIMS} | {f"p{i}{j}": off[i] * off[j] for i in DIMS for j in range(i, 4)}
    for step in range(STEPS):
        model, now = materialize(_factored(model), f"model{step}")
        discard(at)
        at = now
        cells = (
            _attach(vectors, model, few, ["__g"])
            .groupBy("__g", F.ceil(F.log1p(_distance()) * GRID).alias("c"))
            .agg(F.count("*").alias("n"), *[F.first(m).alias(m) for m in middle], *[F.sum(v).alias(k) for k, v in moments.items()])
        )
        near = _placed(cells, ["__g"]).where(F.col("upto") - F.col("n") < H_SHARE * F.col("all"))
        sums = near.groupBy("__g").agg(F.sum("n").alias("n"), *[F.first(m).alias(f"c{i}") for i, m in enumerate(middle)], *[F.sum(k).alias(k) for k in moments])
        mean = [F.col(f"a{i}") / F.col("n") for i in DIMS]
        model = sums.select(
            "__g",
            *[(F.col(f"c{i}") + mean[i]).alias(f"m{i}") for i in DIMS],
            *[(scale * (F.col(f"p{i}{j}") / F.col("n") - mean[i] * mean[j]) + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"s{i}{j}") for i in DIMS for j in range(i, 4)],
        )
    model, _ = materialize(_factored(model), "estimates")
    discard(at)
    return model, few


def _pooled(df: DataFrame) -> DataFrame:
    """Column __g: language and source, or the pool of the language's small sources, or the pool of all the rest."""
    own = df.where("not base_failed").groupBy("__lang", "__source").agg(F.count("*").alias("__n"))
    small = F.sum(F.when(F.col("__n") < MIN_GROUP, F.col("__n")).otherwise(0)).over(Window.partitionBy("__lang"))
    keys = own.withColumn("__s", small).select(
        "__lang",
        "__source",
        F.when(F.col("__n") >= MIN_GROUP, F.to_json(F.array("__lang", "__source")))
        .when(F.col("__s") >= MIN_GROUP, F.to_json(F.array("__lang")))
        .otherwise(F.lit("[]"))
        .alias("__g"),
    )
    keys, _ = materialize(keys, "groups")
    return _attach(df, keys, keys.count() <= BROADCAST_GROUPS, ["__lang", "__source"], "left")


def quality_verdicts(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Kept columns, the statistics, base_failed, distance (squared; null if base_failed) and kept."""
    named = df.select(
        *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)],
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("__lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__source"),
        F.col(text_col).alias("__text"),
    )
    held = [f"__k{i}" for i in range(len(keep))]
    stats = text_statistics(named, "__text", (*held, "__lang", "__source"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    stats, _ = materialize(stats.withColumn("base_failed", failed), "statistics")
    grouped = _pooled(stats).select(*held, *stats.columns[len(held) + 2 :], "__g", *[v.alias(f"v{i}") for i, v in enumerate(_vector())])
    vectors, at = materialize(grouped.where("not base_failed").select("__g", *[f"v{i}" for i in DIMS]), "vectors")
    judged = _attach(grouped, *_estimates(vectors), ["__g"], "left")
    discard(at)
    out = judged.withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUTOFF)
    return out.select(
        *[F.col(h).alias(c) for h, c in zip(held, keep, strict=True)],
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance",
    )
