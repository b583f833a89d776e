"""Strips: the clusters of a tree that are small enough for a task, vectors cut along them, and what is added up over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import cut, settle

MOST_RHS = 4096


def blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def matrix(data: bytes, kind: str, columns: int) -> np.ndarray:
    """kind: D or Z."""
    x = np.frombuffer(data, np.complex128 if kind == "Z" else np.float64)
    return x.reshape(-1, columns) if columns else x.reshape(0, 0)


def prefixes(path: str, least: int = 1) -> Column:
    """All clusters that contain the cluster ``path``, itself included."""
    return F.transform(F.sequence(F.lit(least), F.length(path)), lambda k: F.substring(path, F.lit(1), k))


def strips_of(nodes: DataFrame, points: int) -> DataFrame:
    """(strip, off, n): the largest clusters of at most ``points`` points, or leaves of more; they tile the positions."""
    small = (F.col("n") <= points) | F.col("is_leaf")
    above = nodes.select(F.col("path").alias("parent"), (F.col("n") > points).alias("large"))
    return cut(nodes.where("n > 0").where(small).join(above, "parent", "left").where("parent is null or large").select(F.col("path").alias("strip"), "off", "n"))


def places_of(perm: DataFrame, strips: DataFrame) -> DataFrame:
    """(pos, dof, strip, at): every dof with its strip and its place there."""
    up = perm.select("pos", "dof", F.explode(prefixes("leaf")).alias("strip"))
    return up.join(strips.select("strip", "off"), "strip").select("pos", "dof", "strip", (F.col("pos") - F.col("off")).cast("int").alias("at"))


class Vectors:
    """Right-hand sides (dof, rhs, re[, im]) as one row a strip: (strip, off, n, x), x being n x len(ids) numbers of ``kind``; what is missing is 0."""

    def __init__(self, x: DataFrame, places: DataFrame, strips: DataFrame, kind: str = "D"):
        x = x if "im" in x.columns else x.withColumn("im", F.lit(0.0))
        x = x.select("dof", "rhs", F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))
        seen = x.groupBy("rhs").agg(F.max(F.abs("im")).alias("im")).orderBy("rhs").limit(MOST_RHS + 1).collect()
        if len(seen) > MOST_RHS:
            raise ValueError(f"more than {MOST_RHS} right-hand sides at a time")
        self.ids = [r["rhs"] for r in seen]
        self.kind = "Z" if kind == "Z" or any(r["im"] for r in seen) else "D"
        self.places = places
        ids, complex_ = np.array(self.ids), self.kind == "Z"
        cells = F.collect_list(F.struct("at", "rhs", "re", "im")).alias("s")
        held = places.join(x, "dof").groupBy("strip").agg(cells).select("strip", F.col("s.at").alias("at"), F.col("s.rhs").alias("rhs"), F.col("s.re").alias("re"), F.col("s.im").alias("im"))

        def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for r in frame.itertuples():
                    m = np.zeros((int(r.n), len(ids)), complex if complex_ else float)
                    if r.at is not None:
                        m[np.asarray(r.at), np.searchsorted(ids, np.asarray(r.rhs))] = np.asarray(r.re) + 1j * np.asarray(r.im) if complex_ else np.asarray(r.re)
                    out.append((r.strip, r.off, r.n, blob(m)))
                yield pd.DataFrame(out, columns=["strip", "off", "n", "x"])

        self.table = settle(strips.select("strip", "off", "n").join(held, "strip", "left").mapInPandas(fill, "strip string, off long, n long, x binary"))

    def rows(self, table: DataFrame) -> DataFrame:
        """(dof, rhs, re, im) of a table (strip, x) of the same shape."""
        ids, kind = np.array(self.ids, np.int64), self.kind

        def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for r in frame.itertuples():
                    m = matrix(r.x, kind, len(ids))
                    at, col = np.indices(m.shape).reshape(2, -1)
                    yield pd.DataFrame({"strip": r.strip, "at": at.astype(np.int32), "rhs": ids[col], "re": m.real.ravel(), "im": m.imag.ravel() if kind == "Z" else 0.0})

        if not self.ids:
            return self.places.limit(0).select("dof", F.lit(0).alias("rhs"), F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
        cells = table.select("strip", "x").mapInPandas(spread, "strip string, at int, rhs int, re double, im double")
        return cells.join(self.places, ["strip", "at"]).select("dof", "rhs", "re", "im")


def summed(rows: DataFrame, keys: list[str], column: str = "g") -> DataFrame:
    """Elementwise sums of arrays of doubles by ``keys``: added up inside the tasks first, so that a key's rows never meet in one."""
    cells = rows.select(*keys, F.posexplode(column).alias("at", "v")).groupBy(*keys, "at").agg(F.sum("v").alias("v"))
    return cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("s")).select(*keys, F.col("s.v").alias(column))


def doubles(x: np.ndarray) -> list[float]:
    """Numbers as an array that ``summed`` can add: complex ones as pairs."""
    return np.ascontiguousarray(x).ravel().view(np.float64).tolist()


def numbers(x, kind: str, columns: int) -> np.ndarray:
    return matrix(np.asarray(x, np.float64).tobytes(), kind, columns)


def tree_qr(rows: DataFrame, keys: list[str], count: int, fan: int = 64) -> DataFrame:
    """R of the QR factorization of stacked strips, by ``keys``: (``keys``, r).

    ``rows``: ``keys``, num (0 .. count - 1), kind, columns and r, the R factor of each strip.  ``fan`` of them are stacked and factored again, round by
    round, so that no task holds more than ``fan`` x columns rows.
    """
    names = [*keys, "num", "kind", "columns", "r"]
    schema = ", ".join([*[f"{k} {dict(rows.dtypes)[k]}" for k in keys], "num long, kind string, columns int, r binary"])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.sort_values("num").iloc[0]
        stack = np.concatenate([matrix(r, first["kind"], int(first["columns"])) for r in frame.sort_values("num")["r"]])
        return pd.DataFrame([{**{k: first[k] for k in keys}, "num": int(first["num"]) // fan, "kind": first["kind"], "columns": first["columns"], "r": blob(np.linalg.qr(stack, mode="r"))}], columns=names)

    rows = rows.select(*names)
    while True:
        rows = rows.withColumn("_group", F.expr(f"num div {fan}")).groupBy(*keys, "_group").applyInPandas(merge, schema)
        count = -(-count // fan)
        if count <= 1:
            return rows
        rows = settle(rows)


def basis(r: np.ndarray, least: float = 1e-14) -> tuple[np.ndarray, np.ndarray]:
    """(B, T) for a panel Y with R factor ``r``: the columns of Y B are orthonormal and Y = (Y B) T."""
    _, s, vh = np.linalg.svd(r)
    keep = s > least * s[0] if len(s) and s[0] > 0 else np.zeros(len(s), bool)
    return vh.conj().T[:, : len(s)][:, keep] / s[keep], s[keep, None] * vh[: len(s)][keep]


def each_row(table: DataFrame, change: Callable, schema: str) -> DataFrame:
    """``change(row) -> rows`` over a table."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [y for x in frame.itertuples() for y in change(x)]
            yield pd.DataFrame(out, columns=names)

    return table.mapInPandas(run, schema)
