"""Whitening of embeddings by blockwise TSQR and one-sided Jacobi rotations.

Entries become integers x = floor(scale * entry) + offset, so sums are exact. The components are fitted to each distinct
vector once: n vectors with per-dimension sums S. Rows are centred exactly, as (n * x - S) / n, before anything is
multiplied. Tasks compress their centred rows to triangular factors R, a block at a time (R of R above the next block);
those meet in a tree, so no task ever holds more than FAN factors of d by d numbers. Plane rotations then make R's columns
orthogonal: their lengths are the singular values, to high relative accuracy, and the rotations accumulated are the
components. No covariance matrix is formed on the way.

What the driver holds are S and a few factors of d by d numbers, d being the dimension.

Defined results: a vector that is null, or holds null, NaN or infinite entries, is dropped, as are empty vectors and those
whose length is not the most frequent one (the longer of equally frequent ones). Repeated rows get equal rows and are
fitted once; a null id stays null. Directions in which the fit list does not vary, as judged by rounding error, are no
components, so a list of n vectors has n-1 at most; one vector, or an empty table, gives no rows. Other columns are not
read. A deviation beyond 64 bits is null, and centred entries beyond 64 bits raise an error instead of wrong values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quatrain.llm.common import materialize

SCALE, OFFSET, MOST = 64, 1_000_000, 16
#: Rows that are compressed at a time, and factors that meet in one task of the tree.
BLOCK, FAN = 4096, 16
#: Columns turn above this cosine; sweeps end when all are orthogonal to rounding error.
COSINE, SWEEPS = 1e-15, 60


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors as columns, of a matrix with few columns. Pairs of columns are
    rotated in rounds of a tournament, in which each round's pairs are disjoint and turn together."""
    d = r.shape[1]
    a, v = r.astype(np.float64).copy(), np.eye(d)
    seats = np.arange(d + d % 2)
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(len(seats) - 1):
            i, j = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
            real = (i < d) & (j < d)
            i, j = i[real], j[real]
            x, y = a[:, i], a[:, j]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                cosine = np.abs(gamma) / np.sqrt(alpha * beta)
                turn = np.nan_to_num(cosine) > COSINE
                worst = max(worst, float(np.nan_to_num(cosine).max(initial=0.0)))
                zeta = (beta - alpha) / (2 * gamma)
                tangent = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            tangent = np.where(turn, np.nan_to_num(tangent), 0.0)
            c = 1 / np.sqrt(1 + tangent * tangent)
            s = c * tangent
            for m in (a, v):
                x, y = m[:, i], m[:, j]
                m[:, i], m[:, j] = c * x - s * y, s * x + c * y
            seats = np.concatenate([seats[:1], np.roll(seats[1:], 1)])
        if worst <= np.finfo(np.float64).eps * max(d, 16):
            break
    lengths = np.sqrt((a * a).sum(0))
    order = np.argsort(-lengths, kind="stable")
    return lengths[order], v[:, order]


def as_integers(df: DataFrame, id_col: str, vector_col: str, scale: int, offset: int) -> DataFrame:
    """(id, x) of the rows that are whole, of one length."""
    entries = F.col(vector_col).cast("array<double>")
    whole = df.select(F.col(id_col).alias("id"), entries.alias("v")).where(
        F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    )
    sizes = whole.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return whole.select("id", F.col("v").cast("array<long>").alias("x"))
    return whole.where(F.size("v") == sizes["d"]).select("id", F.transform("v", lambda c: F.floor(c * scale) + offset).alias("x"))


def _grids(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, part.column(column).flatten().to_numpy().reshape(part.num_rows, -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's count, and its sums as a list."""
    n, sums = 0, None
    for part, x in _grids(batches):
        n += part.num_rows
        sums = x.sum(0) if sums is None else sums + x.sum(0)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([sums.tolist()], pa.list_(pa.int64()))], names=["n", "sums"])


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact; OverflowError beyond 64 bits."""
    if len(x) and n * float(np.abs(x).max()) + float(np.abs(sums).max()) >= 2.0**63:
        raise OverflowError("centred entries do not fit into 64 bits")
    return n * x - sums


def _factor(rows: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.concatenate(rows), mode="r")


def _compress(n: int, sums: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for _, x in _grids(batches):
            rows = centred(x, n, sums) / n
            r = _factor([rows] if r is None else [r, rows])
        if r is not None:
            yield _packed(r)

    return run


def _packed(r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])


def _merge(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for packed in batch.column(0):
                more = np.frombuffer(packed.as_py()).reshape(-1, d)
                r = more if r is None else _factor([r, more])
        if r is not None:
            yield _packed(r)

    return run


def triangular(x: DataFrame, n: int, sums: np.ndarray, parts: int) -> np.ndarray:
    """R of the centred rows x, by a tree over the tasks' factors."""
    factors = x.mapInArrow(_compress(n, sums), "r binary")
    while parts > FAN:
        parts = -(-parts // FAN)
        factors = factors.repartition(parts).mapInArrow(_merge(len(sums)), "r binary")
    found = [np.frombuffer(r["r"]).reshape(-1, len(sums)) for r in factors.collect()]
    return _factor(found)


def _moments(project):
    """Count, mean and centred products of a task's whitened rows, block by block (each block about its own mean)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None
        for _, x in _grids(batches):
            w = project(x)
            mean = w.mean(0)
            whole = _joined(whole, (len(w), mean, (w - mean).T @ (w - mean)))
        if whole is not None:
            n, mean, products = whole
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([mean.tobytes()]), pa.array([products.tobytes()])], names=["n", "mean", "products"])

    return run


def _joined(a, b):
    """Moments of two sets of rows together."""
    if a is None:
        return b
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def _merge_moments(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None
        for batch in batches:
            for n, mean, products in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                whole = _joined(whole, (n, np.frombuffer(mean), np.frombuffer(products).reshape(k, k)))
        if whole is not None:
            yield pa.RecordBatch.from_arrays([pa.array([whole[0]], pa.int64()), pa.array([whole[1].tobytes()]), pa.array([whole[2].tobytes()])], names=["n", "mean", "products"])

    return run


MOMENTS = "n long, mean binary, products binary"


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = MOST, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """A row for each whole vector and component: id, component, n, deviation (sum of (n * x - S)^2), whitened, explained
    (share of the variance) and identity_error (of the fit list's whitened covariance)."""
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = as_integers(df, id_col, vector_col, scale, offset)
    # copies fall together by partial aggregation before they move
    fit, _ = materialize(rows.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "vectors")
    sums, n = None, 0
    partial = fit.mapInArrow(_sums, "n long, sums array<long>")
    for r in partial.select("n", F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s"), F.sum("n").alias("n")).orderBy("pos").collect():
        sums, n = [*(sums or []), r["s"]], r["n"]
    if n < 2:
        return df.sparkSession.createDataFrame([], schema)
    sums = np.array(sums, np.int64)
    lengths, components = jacobi(triangular(fit, n, sums, len(fit.inputFiles())))
    there = lengths > lengths[0] * np.finfo(np.float64).eps * max(len(sums), 16)
    lengths, components = lengths[: min(n - 1, int(there.sum()))], components[:, : min(n - 1, int(there.sum()))]
    explained = lengths**2 / (lengths**2).sum()
    k = min(most, len(lengths))
    if not k:
        return df.sparkSession.createDataFrame([], schema)
    matrix = components[:, :k] / (lengths[:k] / np.sqrt(n))

    def project(x: np.ndarray) -> np.ndarray:
        return (centred(x, n, sums) / n) @ matrix

    moments, parts = fit.mapInArrow(_moments(project), MOMENTS), len(fit.inputFiles())
    while parts > FAN:
        parts = -(-parts // FAN)
        moments = moments.repartition(parts).mapInArrow(_merge_moments(k), MOMENTS)
    whole = None
    for r in moments.orderBy("n", "mean").collect():
        whole = _joined(whole, (r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["products"]).reshape(k, k)))
    error = float(np.abs(whole[2] / n - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _grids(batches, 1):
            far = centred(x, n, sums)
            m = part.num_rows
            fits = (far.astype(np.float64) ** 2).sum(1) < 2.0**62
            deviation = np.where(fits, (np.where(fits[:, None], far, 0) ** 2).sum(1), 0)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    pa.array(np.repeat(deviation, k), mask=np.repeat(~fits, k)),
                    pa.array(((far / n) @ matrix).ravel()),
                    pa.array(np.tile(explained[:k], m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
