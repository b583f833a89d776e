"""Whitening of vectors by a covariance summed in double-double arithmetic.

A double-double is a pair (high, low) of doubles whose exact sum is the value; the error-free
transformations below give a sum or a product together with what rounding lost of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ship
from .common import by_group, settle

_SPLIT = float((1 << 27) + 1)


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b = s + e exactly (Knuth)."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a = h + l with 26 bits each (Veltkamp)."""
    t = _SPLIT * a
    h = t - (t - a)
    return h, a - h


def added(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of two double-doubles."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def outer_sums(values: np.ndarray, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum over the rows v of (v - centre)(v - centre)^T as double-doubles: its upper triangle, row by row.  The centre is high + low."""
    d = values.shape[1]
    i, j = np.triu_indices(d)
    total = (np.zeros(len(i)), np.zeros(len(i)))
    size = max(1, (1 << 17) // max(1, len(i)))
    for at in range(0, len(values), size):
        h, e = two_sum(values[at : at + size], -high)
        h, e = two_sum(h, e - low)
        top, rest = halves(h)
        p = h[:, i] * h[:, j]
        q = ((top[:, i] * top[:, j] - p) + top[:, i] * rest[:, j] + rest[:, i] * top[:, j]) + rest[:, i] * rest[:, j]
        q += h[:, i] * e[:, j] + e[:, i] * h[:, j]
        while len(p) > 1:
            half = len(p) // 2
            s = added((p[:half], q[:half]), (p[half : 2 * half], q[half : 2 * half]))
            p, q = (np.concatenate([x, y[2 * half :]]) for x, y in zip(s, (p, q), strict=True))
        total = added(total, (p[0], q[0]))
    return total


def covariance(rows: DataFrame, column: str, n: int, offset: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Covariance (divisor n, extended precision) of an array column around ``offset + high + low``; ``offset`` is subtracted from the entries first, exactly.

    Every task adds up its rows; the d rows of its triangle meet those of 64 tasks' groups, then those of all groups, in a fixed order.
    The driver gets d x d numbers.
    """
    d = len(high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(0).flatten()).reshape(-1, d)
                more = outer_sums((x - offset).astype(np.float64), high, low)
                total = more if total is None else added(total, more)
        if total is not None:
            ends = np.cumsum(np.arange(d, 0, -1))
            cuts = [slice(e - (d - k), e) for k, e in enumerate(ends)]
            yield pa.RecordBatch.from_pydict({"line": pa.array(range(d), pa.int32()), "task": pa.array([TaskContext.get().partitionId()] * d, pa.int64()), "high": [total[0][c].tobytes() for c in cuts], "low": [total[1][c].tobytes() for c in cuts]})

    def merged(line: list[int], task: list[int], high: list[bytes], low: list[bytes]) -> list[tuple]:
        total = None
        for k in sorted(range(len(task)), key=task.__getitem__):
            more = np.frombuffer(high[k]), np.frombuffer(low[k])
            total = more if total is None else added(total, more)
        return [(line[0], min(task) // 64, total[0].tobytes(), total[1].tobytes())]

    kind, types = "line int, task long, high binary, low binary", [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    sums = rows.select(column).mapInArrow(run, kind)
    for group in (F.concat_ws(":", "line", F.expr("task div 64")), F.col("line").cast("string")):
        sums = by_group(sums.withColumn("group", group), "group", ["line", "task", "high", "low"], merged, kind, types)
    out = np.zeros((d, d), np.longdouble)
    for x in sums.collect():
        out[x["line"], x["line"] :] = (np.frombuffer(x["high"]).astype(np.longdouble) + np.frombuffer(x["low"])) / n
        out[x["line"] :, x["line"]] = out[x["line"], x["line"] :]
    return out


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors (columns) of a symmetric matrix.

    Reduction to tridiagonal form and divide and conquer (LAPACK's ``syevd``) in double precision, then two
    rounds of iterative refinement (Ogita and Aishima 2018) in extended precision, so that small eigenvalues are as good as large ones.
    """
    x = np.linalg.eigh(v.astype(np.float64))[1].astype(np.longdouble)
    e = np.zeros(len(v), np.longdouble)
    for _ in range(2):
        r, s = np.eye(len(v)) - x.T @ x, x.T @ v @ x
        e = np.diag(s) / (1 - np.diag(r))
        near = 2 * (np.linalg.norm((s - np.diag(e)).astype(float)) + np.linalg.norm(v.astype(float)) * np.linalg.norm(r.astype(float)))
        gap = e[None, :] - e[:, None]
        far = np.abs(gap) > near
        x = x + x @ np.where(far, (s + e[None, :] * r) / np.where(far, gap, 1), r / 2)
    order = np.argsort(-e, kind="stable")
    return e[order], x[:, order]


def whiten(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", scale: int = 64, shift: int = 1_000_000, most: int = 32, most_dims: int = 2048) -> DataFrame:
    """``key``, ``whitened`` (array, by component), ``n``, ``deviation``, ``explained`` (array) and ``identity_error`` of every vector that takes part.

    Entries c become the integers x = floor(scale * c) + shift.  The covariance V of all vectors is taken around their exact
    mean S / n; component k is its unit eigenvector of the k-th largest eigenvalue e, whitened[k] the vector's
    part along it over sqrt(e), explained[k] = e / trace(V).  deviation is the exact sum over dimensions of (n x - S)^2 (an error beyond
    a long).  identity_error is the largest entry of |covariance of the whitened vectors - identity|, from the vectors themselves.

    Vectors that are null or hold null or non-finite entries take no part, nor do those of another length than most have (ties: the longer).
    Eigenvalues of no more than rounding (d * 2^-52 of the largest) have no component: n equal vectors have none and come with empty arrays.
    Repeated rows count as often as they occur; null keys are kept; an empty table gives none.  Entries of 2^52 or more after scaling and
    more than ``most_dims`` dimensions (d x d numbers reach the driver) are refused.
    """
    ship(vectors.sparkSession)
    v = F.col("_vector")
    rows = vectors.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_vector"))
    rows = rows.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    rows = rows.select("_key", F.transform(v, lambda c: F.when(F.abs(c * scale) < 1 << 52, F.floor(c * scale) + shift)).alias("x"))

    sums = rows.select(F.size("x").alias("d"), F.posexplode("x").alias("at", "x")).groupBy("d", "at").agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("exact"), F.sum("x").alias("s"))
    if sums.where("exact < n").limit(1).count():
        raise ValueError("an entry is too large for exact integers")
    sizes = sums.where("at = 0").orderBy(F.desc("n"), F.desc("d")).select("n", "d").first()
    schema = f"{key} {dict(vectors.select(key).dtypes)[key]}, whitened array<double>, n long, deviation long, explained array<double>, identity_error double"
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], schema)
    n, d = sizes["n"], sizes["d"]
    if d > most_dims:
        raise ValueError(f"vectors of {d} dimensions; at most {most_dims} are whitened")
    total = [x["s"] for x in sums.where(F.col("d") == d).orderBy("at").collect()]
    middle = [(2 * s + n) // (2 * n) for s in total]  # the integers next to the mean
    rest = [s - n * m for s, m in zip(total, middle, strict=True)]
    high = np.array([float(Fraction(r, n)) for r in rest])
    low = np.array([float(Fraction(r, n) - Fraction(h)) for r, h in zip(rest, high.tolist(), strict=True)])
    offset, left = np.array(middle, np.int64), np.array(rest, object)

    fitted = rows.where(F.size("x") == d)
    cov = covariance(fitted, "x", n, offset, high, low)
    e, x = components(cov)
    k = int(min(most, (e > d * 2.0**-52 * max(e[0], 0)).sum()))
    project = (x[:, :k] / np.sqrt(e[:k])).astype(np.float64)
    shares = (e[:k] / np.trace(cov)).astype(np.float64).tolist() if k else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.asarray(batch.column(1).flatten()).reshape(-1, d) - offset
            w = ((at - high) - low) @ project
            if n * (int(np.abs(at).max(initial=0)) + 1) < 1 << 28:
                dev = ((n * at - left.astype(np.int64)) ** 2).sum(1) if d < 128 else ((n * at - left.astype(np.int64)).astype(object) ** 2).sum(1)
            else:
                dev = ((n * at.astype(object) - left) ** 2).sum(1)
            flat = pa.array(w.ravel(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([int(t) for t in dev], pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * k), flat)], names=["_key", "deviation", "whitened"])

    kind = dict(rows.dtypes)["_key"]
    white = settle(fitted.mapInArrow(run, f"_key {kind}, deviation long, whitened array<double>"))
    error = 0.0
    if k:
        means = white.select(F.posexplode("whitened").alias("at", "w")).groupBy("at").agg(F.avg("w").alias("m")).orderBy("at").collect()
        centre = np.array([r["m"] for r in means])
        error = float(np.abs(covariance(white, "whitened", n, np.zeros(k), centre, np.zeros(k)) - np.eye(k)).max())
    explained = F.array(*[F.lit(s) for s in shares]).cast("array<double>")
    return white.select(F.col("_key").alias(key), "whitened", F.lit(n).cast("long").alias("n"), "deviation", explained.alias("explained"), F.lit(error).alias("identity_error"))


def by_component(white: DataFrame, *, key: str = "vec_id") -> DataFrame:
    """One row for each vector and component, numbered from 1."""
    cells = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "cell")
    rows = white.select(key, "n", "deviation", "identity_error", cells)
    return rows.select(key, (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("cell.whitened").alias("whitened"), F.col("cell.explained").alias("explained"), "identity_error")
