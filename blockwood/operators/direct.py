"""A kernel matrix times vectors, once: no leaf is stored.

The near field is a join of the pairs of points in dense blocks with the kernel as a Column expression; the
panels of the far field live in the task that computes and applies them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ship
from ..functions.kernels import Kernel
from .blocks import Admissibility, build_blocks
from .cluster import Clustering, build_tree
from .matrix import HMatrix, seed_of, segments

_PARTS = "pos long, rhs int, re double, im double"


def kernel_product(points: DataFrame, kernel: Kernel, x: DataFrame, *, columns: DataFrame | None = None, clustering: Clustering = Clustering(), admissibility: Admissibility = Admissibility(), method: str = "aca_plus", eps: float = 1e-4, least_svd: int = 0, task_points: int = 1_000_000) -> DataFrame:
    """(dof, rhs, re, im) of k(p, q) x for all right-hand sides of ``x``, as ``HMatrix.build(...).gemv(x)`` gives it.

    Kernels without a Column form (a user's function, hints) and blocks beyond ``task_points`` go through leaves that are
    made while they are used.
    """
    ship(points.sparkSession)
    row_nodes, row_perm = build_tree(points, clustering)
    col_nodes, col_perm = (row_nodes, row_perm) if columns is None else build_tree(columns, clustering)
    blocks = build_blocks(row_nodes, col_nodes, admissibility)
    m = HMatrix(row_nodes, row_perm, col_nodes, col_perm, blocks, None)
    x = x if "im" in x.columns else x.withColumn("im", F.lit(0.0))
    small = F.col("r_n") + F.col("c_n") <= task_points
    near, far = F.col("kind") == "full", (F.col("kind") == "rk") & small
    parts = far_field(replace(m, blocks=blocks.where(far)), kernel, x, method, eps, least_svd)
    if kernel.has_columns:
        parts = parts.unionByName(near_field(replace(m, blocks=blocks.where(near)), kernel, x))
    parts = parts.groupBy("pos", "rhs").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    out = parts.join(row_perm.select("pos", "dof"), "pos").select("dof", "rhs", "re", "im")
    rest = blocks.where(F.lit(False) if kernel.has_columns else near).unionByName(blocks.where((F.col("kind") == "rk") & ~small))
    if not rest.limit(1).count():
        return out
    left = replace(m, blocks=rest)
    for k in (replace(kernel, strata=()), *kernel.strata):  # products add up, so strata need no common panels
        scalar = "D" if k.name in ("exp", "laplace", "gram") else "Z"
        out = out.unionByName(replace(left, leaves=left.assembled(k, method, eps, scalar, least_svd, task_points=task_points)).gemv(x))
    return out.groupBy("dof", "rhs").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def _members(perm: DataFrame, paths: DataFrame, name: str, size: int) -> DataFrame:
    """Every point of the clusters ``paths``: its cluster as ``name``, its dof, position and coordinates."""
    up = perm.withColumn(name, F.explode(F.transform(F.sequence(F.lit(1), F.length("leaf")), lambda k: F.substring("leaf", F.lit(1), k))))
    up = up.join(paths.select(F.col(name)).distinct(), name, "left_semi")
    return up.select(name, F.col("dof").alias(f"{name}_dof"), F.col("pos").alias(f"{name}_pos"), *[F.element_at("coord", i + 1).alias(f"{name}{i}") for i in range(size)])


def near_field(m: HMatrix, kernel: Kernel, x: DataFrame) -> DataFrame:
    """Partial products (pos, rhs, re, im) of the dense blocks of ``m``.

    A row point meets the columns of each dense block of its cluster: as many pairs as the dense blocks have entries. Pairs
    are summed by row before anything is shuffled, and no task holds more than the pairs that it streams.  Points and vectors meet in
    merge joins: none of them goes through the driver, however small its file.
    """
    first = m.row_perm.select(F.size("coord").alias("n")).first()
    size = first["n"] if first else 0
    blocks = m.blocks.select("r", "c")
    rows = blocks.join(_members(m.row_perm, blocks, "r", size), "r").drop("r")
    cols = _members(m.col_perm, blocks, "c", size).join(x.select(F.col("dof").alias("c_dof"), "rhs", F.col("re").alias("x_re"), F.col("im").alias("x_im")).hint("merge"), "c_dof")
    pairs = rows.hint("merge").join(cols, "c")
    re, im = kernel.column([F.col(f"r{i}") for i in range(size)], [F.col(f"c{i}") for i in range(size)], F.col("r_dof") == F.col("c_dof"))
    a, b = F.col("x_re"), F.col("x_im")
    if im is None:
        pairs = pairs.select("r_pos", "rhs", (re * a).alias("re"), (re * b).alias("im"))
    else:
        pairs = pairs.select("r_pos", "rhs", a, b, re.alias("k_re"), im.alias("k_im")).select("r_pos", "rhs", (F.col("k_re") * a - F.col("k_im") * b).alias("re"), (F.col("k_re") * b + F.col("k_im") * a).alias("im"))
    return pairs.groupBy(F.col("r_pos").alias("pos"), "rhs").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def far_field(m: HMatrix, kernel: Kernel, x: DataFrame, method: str, eps: float, least_svd: int = 0) -> DataFrame:
    """Partial products (pos, rhs, re, im) of the low-rank blocks of ``m``: compressed and applied in one task each, panels are never moved."""
    blocks = m.blocks.select("r", "c", "r_off", "r_n", "c_off", "c_n")
    rows = segments(m.row_perm, blocks.select(F.col("r").alias("path"))).select(F.col("path").alias("r"), F.col("dofs").alias("r_dofs"), F.col("coords").alias("r_coords"))
    cols = segments(m.col_perm, blocks.select(F.col("c").alias("path"))).select(F.col("path").alias("c"), F.col("dofs").alias("c_dofs"), F.col("coords").alias("c_coords"))
    values = m._segments_of(x, m.col_perm, blocks.select(F.col("c").alias("path")), "c")

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for z in frame.itertuples():
                p, q = np.asarray(z.r_coords, float).reshape(z.r_n, -1), np.asarray(z.c_coords, float).reshape(z.c_n, -1)
                a, b = kernel.panels(p, q, np.asarray(z.r_dofs), np.asarray(z.c_dofs), method, eps, seed_of(z), least_svd)
                piece = (np.asarray(z.x_re, float) + 1j * np.asarray(z.x_im, float)).reshape(-1, z.c_n).T
                y = (a @ (b.T @ (piece if piece.imag.any() else piece.real))).T  # a row for each right-hand side
                rhs = np.asarray(z.x_rhs)[:: z.c_n]
                yield pd.DataFrame({"pos": np.tile(z.r_off + np.arange(z.r_n), len(rhs)), "rhs": np.repeat(rhs, z.r_n), "re": y.real.ravel(), "im": y.imag.ravel() if np.iscomplexobj(y) else np.zeros(y.size)})

    return blocks.join(rows.hint("merge"), "r").join(cols.hint("merge"), "c").join(values.hint("merge"), "c").mapInPandas(apply, _PARTS)
