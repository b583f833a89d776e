"""Hierarchical matrices: blocks and payloads as DataFrame rows, linear algebra as joins and grouped sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from types import SimpleNamespace
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ship
from ..frames import cut, settle
from ..functions import bits, lowrank
from ..functions.kernels import Kernel
from .blocks import Admissibility, build_blocks
from .cluster import Clustering, build_tree
from . import product, wide

if TYPE_CHECKING:
    from .factor import Factor

LEAF = "r string, c string, r_off long, r_n long, c_off long, c_n long, kind string, rank int, eps double, dtype string, a binary, b binary, d binary"
LEAF_NAMES = [x.split()[0] for x in LEAF.split(", ")]
PIECE = 2048  # rows and columns of a leaf's pieces in ``values``
TASK_CELLS = 1 << 24  # entries that a task of ``values`` expands
_NUM = {"S": np.float32, "D": np.float64, "C": np.complex64, "Z": np.complex128}
_PACKED = {"P": "D", "Q": "Z"}  # leaves as packed integers (``bits``): what they become once changed
COMPLEX = ("C", "Z", "Q")


def _array(blob: bytes, kind: str, rows: int) -> np.ndarray:
    return np.frombuffer(blob, _NUM[kind]).reshape(rows, -1)


def payload(x) -> np.ndarray | lowrank.Rk:
    """A leaf row's full array or low-rank pair, in double precision."""
    up = np.complex128 if x.dtype in COMPLEX else np.float64
    if x.dtype in _PACKED:
        return bits.numbers(x.d, x.dtype == "Q") if x.kind == "full" else tuple(bits.numbers(p, x.dtype == "Q") for p in (x.a, x.b))
    if x.kind == "full":
        return np.frombuffer(x.d, _NUM[x.dtype]).reshape(x.r_n, x.c_n).astype(up)
    k = int(x.rank)
    return np.frombuffer(x.a, _NUM[x.dtype]).reshape(x.r_n, k).astype(up), np.frombuffer(x.b, _NUM[x.dtype]).reshape(x.c_n, k).astype(up)


def packed(x, value) -> dict:
    """Columns of a leaf row with another payload."""
    dtype = _PACKED.get(x.dtype, x.dtype)
    kind = _NUM[dtype]
    if isinstance(value, tuple):
        return {"dtype": dtype, "kind": "rk", "rank": value[0].shape[1], "a": np.ascontiguousarray(value[0], kind).tobytes(), "b": np.ascontiguousarray(value[1], kind).tobytes(), "d": None}
    return {"dtype": dtype, "kind": "full", "rank": None, "a": None, "b": None, "d": np.ascontiguousarray(value, kind).tobytes()}


def dense_of(value) -> np.ndarray:
    return value[0] @ value[1].T if isinstance(value, tuple) else value


def noise(epsilon: float, seed: int) -> Callable:
    """A change of leaves: see ``HMatrix.perturbed``."""

    def change(x, v):
        rng = np.random.default_rng((seed, x.r_off, x.c_off))
        f = lambda m: m * (1 + epsilon * rng.uniform(-1, 1, m.shape))
        return (f(v[0]), v[1]) if isinstance(v, tuple) else f(v)

    return change


def seed_of(x) -> int:
    """The seed of a block's random choices."""
    return x.r_off * 1_000_003 + x.c_off


def segments(perm: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, pos[], dof[], coord[]) of the clusters ``paths``, in internal order."""
    up = perm.withColumn("path", F.explode(F.transform(F.sequence(F.lit(1), F.length("leaf")), lambda k: F.substring("leaf", F.lit(1), k))))
    up = up.join(paths.distinct(), "path", "left_semi")
    cells = F.sort_array(F.collect_list(F.struct("pos", "dof", "coord")))
    return up.groupBy("path").agg(cells.alias("s")).select("path", F.col("s.dof").alias("dofs"), F.flatten("s.coord").alias("coords"))


@dataclass(frozen=True)
class HMatrix:
    """``nodes``/``perm`` of rows and columns, all ``blocks``, the ``leaves`` with payloads, and whether only the lower half is stored."""

    row_nodes: DataFrame
    row_perm: DataFrame
    col_nodes: DataFrame
    col_perm: DataFrame
    blocks: DataFrame
    leaves: DataFrame
    symmetric: bool = False

    # -------------------------------------------------------- building

    @staticmethod
    def structure(points: DataFrame, *, columns: DataFrame | None = None, clustering: Clustering = Clustering(), admissibility: Admissibility = Admissibility(), symmetric: bool = False) -> HMatrix:
        """Trees and block tree alone: a matrix without leaves, for what needs no values."""
        ship(points.sparkSession)
        row_nodes, row_perm = build_tree(points, clustering)
        col_nodes, col_perm = (row_nodes, row_perm) if columns is None else build_tree(columns, clustering)
        return HMatrix(row_nodes, row_perm, col_nodes, col_perm, build_blocks(row_nodes, col_nodes, admissibility, symmetric), None, symmetric)

    @staticmethod
    def build(points: DataFrame, kernel: Kernel, *, columns: DataFrame | None = None, clustering: Clustering = Clustering(), admissibility: Admissibility = Admissibility(), symmetric: bool = False, method: str = "svd", eps: float = 1e-4, scalar: str = "D", least_svd: int = 0, validate: bool = False, task_points: int = 1_000_000) -> HMatrix:
        """Trees, block tree and assembled leaves of k(p, q) over ``points`` (rows) and ``columns`` (default: the same); ``task_points``: see ``assembled``."""
        empty = HMatrix.structure(points, columns=columns, clustering=clustering, admissibility=admissibility, symmetric=symmetric)
        out = replace(empty, leaves=settle(empty.assembled(kernel, method, eps, scalar, least_svd, task_points=task_points)))
        if validate:
            worst = out.validated(kernel).where(F.col("error") > 10 * eps * F.col("norm")).orderBy(F.desc("error")).first()
            if worst is not None:
                raise ValueError(f"a block misses its precision: {worst}")
        return out

    def assembled(self, kernel: Kernel, method: str = "svd", eps: float = 1e-4, scalar: str = "D", least_svd: int = 0, dense: bool = False, task_points: int = 1_000_000) -> DataFrame:
        """Leaf payloads: each block with the coordinates of its two clusters is one row of one task.

        Values are computed in double precision, compressed (strata one by one, truncated after each), then stored as ``scalar``.
        Low-rank blocks of more than ``task_points`` rows and columns are compressed over the cluster (``wide``), whatever the method.
        """
        open_ = self.blocks.where("kind <> 'node'").select("r", "c", "r_off", "r_n", "c_off", "c_n", "kind")
        large = open_.where(f"kind = 'rk' and r_n + c_n > {task_points}").withColumn("id", F.concat_ws(":", "r", "c"))
        if not dense and large.limit(1).count():
            panels = wide.cross_approximation(large, self.row_perm, self.col_perm, kernel, eps, max(1, min(10_000, task_points // 2)), "Z" if scalar in COMPLEX else "D")
            rest = replace(self, blocks=self.blocks.where(f"kind = 'full' or (kind = 'rk' and r_n + c_n <= {task_points})"))
            return rest.assembled(kernel, method, eps, scalar, least_svd).unionByName(wide.leaves_of(panels, large, eps, scalar))
        rows = segments(self.row_perm, open_.select(F.col("r").alias("path"))).select(F.col("path").alias("r"), F.col("dofs").alias("r_dofs"), F.col("coords").alias("r_coords"))
        cols = segments(self.col_perm, open_.select(F.col("c").alias("path"))).select(F.col("path").alias("c"), F.col("dofs").alias("c_dofs"), F.col("coords").alias("c_coords"))
        names = [x.split()[0] for x in LEAF.split(", ")]

        def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for x in frame.itertuples():
                    p, q = np.asarray(x.r_coords, float).reshape(x.r_n, -1), np.asarray(x.c_coords, float).reshape(x.c_n, -1)
                    where = (p, q, np.asarray(x.r_dofs), np.asarray(x.c_dofs))
                    parts = (kernel, *kernel.strata)
                    if x.kind == "rk" and not dense:
                        value = kernel.panels(*where, method, eps, seed_of(x), least_svd)
                    else:
                        value = sum(k.block(*where) for k in parts)
                    row = {n: getattr(x, n) for n in names[:6]} | {"eps": eps, "dtype": scalar if not dense else "Z" if np.iscomplexobj(value) else "D"}
                    out.append(row | packed(SimpleNamespace(**row), value))
                yield pd.DataFrame(out, columns=names)

        return open_.join(rows, "r").join(cols, "c").mapInPandas(fill, LEAF)

    def map_leaves(self, change: Callable, kind: str | None = None) -> HMatrix:
        """``change(row, payload) -> payload`` on every leaf (or those of one kind)."""
        names = [x.split()[0] for x in LEAF.split(", ")]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for x in frame.itertuples():
                    row = {n: getattr(x, n) for n in names}
                    out.append(row | packed(x, change(x, payload(x))) if kind in (None, x.kind) else row)
                yield pd.DataFrame(out, columns=names)

        return replace(self, leaves=self.leaves.mapInPandas(run, LEAF))

    # -------------------------------------------------------- elementwise and structural

    def scale(self, alpha: complex) -> HMatrix:
        return self.map_leaves(lambda x, v: (alpha * v[0], v[1]) if isinstance(v, tuple) else alpha * v)

    def conjugate(self) -> HMatrix:
        return self.map_leaves(lambda x, v: (v[0].conj(), v[1].conj()) if isinstance(v, tuple) else v.conj())

    def truncate(self, eps: float | None = None) -> HMatrix:
        return self.map_leaves(lambda x, v: lowrank.truncate(v, x.eps if eps is None else eps), "rk")

    def with_epsilon(self, eps: float) -> HMatrix:
        return replace(self, leaves=self.leaves.withColumn("eps", F.lit(float(eps))))

    def copy_structure(self) -> HMatrix:
        """The same blocks, all zero."""
        return self.map_leaves(lambda x, v: lowrank.zero_rk(x.r_n, x.c_n) if isinstance(v, tuple) else 0 * v)

    def add_identity(self, alpha: float) -> HMatrix:
        """A + alpha I; the diagonal must lie in dense leaves."""

        def more(x, v):
            lo, hi = max(x.r_off, x.c_off), min(x.r_off + x.r_n, x.c_off + x.c_n)
            if hi > lo:
                if isinstance(v, tuple):
                    raise ValueError("a low-rank block meets the diagonal")
                v = v.copy()
                i = np.arange(lo, hi)
                v[i - x.r_off, i - x.c_off] += alpha
            return v

        return self.map_leaves(more)

    def perturbed(self, epsilon: float, seed: int = 0) -> HMatrix:
        """Every entry (of panels: of a) times 1 + epsilon * u, u uniform in [-1, 1] from a seed and the block."""
        return self.map_leaves(noise(epsilon, seed))

    def row_changes(self, change: Callable, bound: float) -> DataFrame:
        """What ``change(row, payload) -> payload`` on every leaf does to each row of the matrix: (row_dof, cells, inside, largest), the row's
        entries, those that move by at most ``bound`` of themselves, and the largest move.

        A leaf is changed and summed by rows in the task that has it: neither matrix is stored, no entry is shuffled or joined.
        """
        if self.symmetric:
            raise ValueError("changes by row need both halves of the matrix")

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for x in frame.itertuples():
                    v = payload(x)
                    w = change(x, v)
                    step = max(1, lowrank.TILE // max(1, int(x.c_n)))  # rows of the leaf that are expanded at once
                    for at in range(0, int(x.r_n), step):
                        m, n = (dense_of((y[0][at : at + step], y[1]) if isinstance(y, tuple) else y[at : at + step]) for y in (v, w))
                        gap = np.abs(n - m)
                        out.append((x.r_off + at + np.arange(len(m)), np.full(len(m), m.shape[1]), (gap <= bound * np.abs(m)).sum(1), gap.max(1)))
                if out:
                    part = pd.DataFrame({n: np.concatenate(c) for n, c in zip(("pos", "cells", "inside", "largest"), zip(*out), strict=True)})
                    yield part.groupby("pos", as_index=False).agg({"cells": "sum", "inside": "sum", "largest": "max"})

        parts = self.leaves.mapInPandas(run, "pos long, cells long, inside long, largest double")
        rows = parts.groupBy("pos").agg(F.sum("cells").alias("cells"), F.sum("inside").alias("inside"), F.max("largest").alias("largest"))
        return rows.join(self.row_perm.select("pos", F.col("dof").alias("row_dof")), "pos").select("row_dof", "cells", "inside", "largest")

    def transpose(self) -> HMatrix:
        flip = {"r": "c", "c": "r", "r_off": "c_off", "r_n": "c_n", "c_off": "r_off", "c_n": "r_n"}
        names = [x.split()[0] for x in LEAF.split(", ")]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for x in frame.itertuples():
                    before = SimpleNamespace(kind="full", dtype=x.dtype, d=x.d, r_n=int(x.c_n), c_n=int(x.r_n))
                    out.append({n: getattr(x, n) for n in names} | packed(x, payload(before).T))
                yield pd.DataFrame(out, columns=names)

        turned = self.leaves.select([F.col({"a": "b", "b": "a"}.get(n, flip.get(n, n))).alias(n) for n in names])
        leaves = turned.where("kind = 'rk'").unionByName(turned.where("kind <> 'rk'").mapInPandas(run, LEAF))
        back = {"parent_r": "parent_c", "parent_c": "parent_r", "i": "j", "j": "i"} | flip
        blocks = self.blocks.select([F.col(back.get(n, n)).alias(n) for n in self.blocks.columns])
        return HMatrix(self.col_nodes, self.col_perm, self.row_nodes, self.row_perm, blocks, leaves, self.symmetric)

    def axpy(self, alpha: complex, other: HMatrix) -> HMatrix:
        """self + alpha * other, block by block; with another block tree the other's leaves are cut to those of this one that they meet."""
        if (self.row_perm is not other.row_perm or self.col_perm is not other.col_perm) and self._order(other):
            raise ValueError("the two matrices number their points differently")
        mine, yours = self.leaves.select("r", "c"), other.leaves.select("r", "c")
        if self.symmetric != other.symmetric or mine.join(yours, ["r", "c"], "full_outer").count() != mine.join(yours, ["r", "c"]).count():
            eps = self.leaves.agg(F.max("eps")).first()[0]
            return replace(self, leaves=product.accumulate(self, product.parts_of(other, alpha), eps))
        names = [x.split()[0] for x in LEAF.split(", ")]
        theirs = other.leaves.select("r", "c", *[F.col(n).alias(f"o_{n}") for n in names[2:]])

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for x in frame.itertuples():
                    row = {n: getattr(x, n) for n in names}
                    if x.o_kind is not None:
                        o = SimpleNamespace(**{n: getattr(x, n if n in ("r", "c") else f"o_{n}") for n in names})
                        o.r_n, o.c_n = int(x.r_n), int(x.c_n)
                        v, w = payload(x), payload(o)
                        if isinstance(v, tuple):
                            value = lowrank.add([(1, v), (alpha, w if isinstance(w, tuple) else lowrank.svd(w, x.eps))], x.eps)
                        else:
                            value = v + alpha * dense_of(w)
                        row |= packed(x, value)
                    out.append(row)
                yield pd.DataFrame(out, columns=names)

        return replace(self, leaves=self.leaves.join(theirs, ["r", "c"], "left").mapInPandas(run, LEAF))

    def _order(self, other: HMatrix) -> bool:
        """Whether positions belong to other dofs than in ``other``."""
        return self._order_of(self.row_perm, other.row_perm) or self._order_of(self.col_perm, other.col_perm)

    @staticmethod
    def _order_of(a: DataFrame, b: DataFrame) -> bool:
        if a is b:
            return False
        a, b = a.select("pos", "dof"), b.select("pos", "dof").toDF("pos", "dof")
        return a.join(b, ["pos", "dof"], "full_outer").count() != a.join(b, ["pos", "dof"]).count()

    def coarsen(self, eps: float) -> HMatrix:
        """Merges sibling blocks that are all low rank where one block is cheaper, from the leaves up, level by level."""
        names = [x.split()[0] for x in LEAF.split(", ")]
        places = self.blocks.select("r", "c", "parent_r", "parent_c", "depth").withColumn("k", F.count(F.lit(1)).over(_window("parent_r", "parent_c")))
        parents = self.blocks.select(F.col("r").alias("parent_r"), F.col("c").alias("parent_c"), F.col("r_off").alias("p_ro"), F.col("r_n").alias("p_rn"), F.col("c_off").alias("p_co"), F.col("c_n").alias("p_cn"))
        out = self
        deepest = self.blocks.agg(F.max("depth")).first()[0]

        def merge(table: pd.DataFrame) -> pd.DataFrame:
            keep = table[names]
            if len(table) != table.k.iloc[0] or (table.kind != "rk").any():
                return keep
            x = SimpleNamespace(**table.iloc[0].to_dict())
            a_parts, b_parts, cost = [], [], 0
            for row in table.itertuples():
                a, b = payload(row)
                big_a, big_b = np.zeros((x.p_rn, a.shape[1]), a.dtype), np.zeros((x.p_cn, a.shape[1]), a.dtype)
                big_a[row.r_off - x.p_ro : row.r_off - x.p_ro + row.r_n], big_b[row.c_off - x.p_co : row.c_off - x.p_co + row.c_n] = a, b
                a_parts.append(big_a)
                b_parts.append(big_b)
                cost += a.size + b.size
            value = lowrank.truncate((np.concatenate(a_parts, 1), np.concatenate(b_parts, 1)), eps)
            if value[0].size + value[1].size >= cost:
                return keep
            row = {"r": x.parent_r, "c": x.parent_c, "r_off": x.p_ro, "r_n": x.p_rn, "c_off": x.p_co, "c_n": x.p_cn, "eps": x.eps, "dtype": x.dtype}
            return pd.DataFrame([row | packed(x, value)], columns=names)

        for depth in range(deepest, 0, -1):
            here = out.leaves.join(places.where(F.col("depth") == depth), ["r", "c"]).join(parents, ["parent_r", "parent_c"])
            rest = out.leaves.join(places.where(F.col("depth") == depth).select("r", "c"), ["r", "c"], "left_anti")
            out = replace(out, leaves=settle(rest.select(names).unionByName(here.groupBy("parent_r", "parent_c").applyInPandas(merge, LEAF))))
        kept = out.leaves.select("r", "c", F.col("kind").alias("new_kind"))
        blocks = self.blocks.join(kept, ["r", "c"], "left").withColumn("kind", F.coalesce("new_kind", F.lit("node"))).drop("new_kind")
        return replace(out, blocks=blocks)

    # -------------------------------------------------------- values

    def entries(self) -> DataFrame:
        """(row_pos, col_pos, re, im) of all stored entries, in internal numbering."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for x in frame.itertuples():
                    v = payload(x)
                    step = max(1, lowrank.TILE // max(1, int(x.c_n)))  # rows of the leaf that are expanded at once
                    for at in range(0, int(x.r_n), step):
                        m = dense_of((v[0][at : at + step], v[1]) if isinstance(v, tuple) else v[at : at + step])
                        i, j = np.indices(m.shape).reshape(2, -1)
                        yield pd.DataFrame({"row_pos": x.r_off + at + i, "col_pos": x.c_off + j, "re": m.real.ravel(), "im": m.imag.ravel() if np.iscomplexobj(m) else 0.0})

        return self.leaves.mapInPandas(run, "row_pos long, col_pos long, re double, im double")

    def values(self) -> DataFrame:
        """(row_dof, col_dof, re, im) of the whole matrix; missing halves are mirrored.

        Leaves take the dofs of their clusters along and are cut to pieces, which are dealt evenly by number: no entry is
        shuffled or joined, and no task holds more than a few pieces.
        """
        root = self.blocks.where("parent_r is null").select((F.col("r_n") * F.col("c_n")).alias("cells")).first()
        tasks = -(-root["cells"] // TASK_CELLS) if root is not None else 1
        names = ["r_off", "r_n", "c_off", "c_n", "kind", "rank", "dtype", "a", "b", "d", "r_dofs", "c_dofs", "twice"]
        kind = "r_off long, r_n long, c_off long, c_n long, kind string, rank int, dtype string, a binary, b binary, d binary, r_dofs array<long>, c_dofs array<long>, twice boolean"
        symmetric = self.symmetric

        def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out, size = [], 0
                for x in frame.itertuples():
                    v = payload(x)
                    for i in range(0, int(x.r_n), PIECE):
                        for j in range(0, int(x.c_n), PIECE):
                            rows, cols = slice(i, min(i + PIECE, int(x.r_n))), slice(j, min(j + PIECE, int(x.c_n)))
                            place = {"r_off": x.r_off + i, "r_n": rows.stop - i, "c_off": x.c_off + j, "c_n": cols.stop - j, "r_dofs": x.r_dofs[rows], "c_dofs": x.c_dofs[cols], "twice": symmetric and x.r_off != x.c_off}
                            piece = (v[0][rows], v[1][cols]) if isinstance(v, tuple) else v[rows, cols]
                            out.append(place | packed(x, piece))
                            size += sum(p.size for p in piece) if isinstance(v, tuple) else piece.size
                            if size >= lowrank.TILE:
                                yield pd.DataFrame(out, columns=names)
                                out, size = [], 0
                if out:
                    yield pd.DataFrame(out, columns=names)

        def expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def table(out: list[tuple]) -> pd.DataFrame:
                return pd.DataFrame({n: np.concatenate(c) for n, c in zip(("row_dof", "col_dof", "re", "im"), zip(*out), strict=True)})

            for frame in frames:
                out, size = [], 0
                for x in frame.itertuples():
                    v = payload(x)
                    step = max(1, lowrank.TILE // max(1, int(x.c_n)))  # rows that are expanded at once
                    for at in range(0, int(x.r_n), step):
                        m = dense_of((v[0][at : at + step], v[1]) if isinstance(v, tuple) else v[at : at + step])
                        i, j = np.repeat(x.r_dofs[at : at + step], m.shape[1]), np.tile(x.c_dofs, len(m))
                        re, im = m.real.ravel(), m.imag.ravel() if np.iscomplexobj(m) else np.zeros(m.size)
                        out += [(i, j, re, im), (j, i, re, im)] if x.twice else [(i, j, re, im)]
                        size += m.size
                        if size >= lowrank.TILE:
                            yield table(out)
                            out, size = [], 0
                if out:
                    yield table(out)

        leaves = self.leaves.select("r", "c", *[n for n in names if n in LEAF_NAMES])
        rows, cols = (segments(perm, self.blocks.where("kind <> 'node'").select(F.col(s).alias("path"))).select(F.col("path").alias(s), F.col("dofs").alias(f"{s}_dofs")) for perm, s in ((self.row_perm, "r"), (self.col_perm, "c")))
        cut_ = leaves.join(rows, "r").join(cols, "c").mapInPandas(pieces, kind)
        return cut_.repartition(tasks).mapInPandas(expand, "row_dof long, col_dof long, re double, im double")

    def get_values(self, rows: DataFrame, cols: DataFrame) -> DataFrame:
        """(row_dof, col_dof, re, im) for all of ``rows`` (dof) with all of ``cols`` (dof); leaves that none of them meets are not touched.

        The ids go to the clusters that hold them, each leaf meets the two lists on its sides and evaluates those entries alone.
        """
        names = ["r", "c", "r_off", "r_n", "c_off", "c_n", "kind", "rank", "dtype", "a", "b", "d"]

        def held(ids: DataFrame, perm: DataFrame, side: str) -> DataFrame:
            up = perm.join(ids.select("dof").distinct(), "dof").withColumn(side, F.explode(F.transform(F.sequence(F.lit(1), F.length("leaf")), lambda k: F.substring("leaf", F.lit(1), k))))
            return up.groupBy(side).agg(F.sort_array(F.collect_list(F.struct("pos", "dof"))).alias(f"{side}_ids"))

        def evaluate(turned: bool):
            def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for frame in frames:
                    for x in frame.itertuples():
                        v = payload(x)
                        if turned:
                            v = (v[1], v[0]) if isinstance(v, tuple) else v.T
                        lists = [(np.array([e["pos"] for e in ids]), np.array([e["dof"] for e in ids])) for ids in (x.r_ids, x.c_ids)]
                        (i, di), (j, dj) = ((lists[1], lists[0]) if turned else lists)
                        i, j = i - (x.c_off if turned else x.r_off), j - (x.r_off if turned else x.c_off)
                        m = v[0][i] @ v[1][j].T if isinstance(v, tuple) else v[np.ix_(i, j)]
                        yield pd.DataFrame({"row_dof": np.repeat(di, len(dj)), "col_dof": np.tile(dj, len(di)), "re": m.real.ravel(), "im": m.imag.ravel() if np.iscomplexobj(m) else 0.0})

            return run

        kind = "row_dof long, col_dof long, re double, im double"
        leaves = self.leaves.select(names)
        out = leaves.join(held(rows, self.row_perm, "r"), "r").join(held(cols, self.col_perm, "c"), "c").mapInPandas(evaluate(False), kind)
        if self.symmetric:
            low = leaves.where("r_off <> c_off")
            out = out.unionByName(low.join(held(cols, self.row_perm, "r"), "r").join(held(rows, self.col_perm, "c"), "c").mapInPandas(evaluate(True), kind))
        return out

    def child(self, i: int, j: int) -> HMatrix:
        """The sub-matrix of the root's block (i, j); positions stay those of the whole."""
        root = self.blocks.where("parent_r is null").select(F.col("r").alias("root_r"), F.col("c").alias("root_c")).first()
        if root is None:
            raise ValueError("an empty matrix")
        here = self.blocks.where((F.col("parent_r") == root["root_r"]) & (F.col("parent_c") == root["root_c"]) & (F.col("i") == i) & (F.col("j") == j)).select("r", "c", "r_off", "c_off").first()
        if here is None:
            raise ValueError(f"no block ({i}, {j})")
        inside = F.col("r").startswith(here["r"]) & F.col("c").startswith(here["c"])
        top = (F.col("r") == here["r"]) & (F.col("c") == here["c"])
        blocks = self.blocks.where(inside).withColumns({n: F.when(~top, F.col(n)) for n in ("parent_r", "parent_c")})
        side = lambda nodes, path: nodes.where(F.col("path").startswith(path))
        perm = lambda p, path: p.where(F.col("leaf").startswith(path))
        return HMatrix(side(self.row_nodes, here["r"]), perm(self.row_perm, here["r"]), side(self.col_nodes, here["c"]), perm(self.col_perm, here["c"]), blocks, self.leaves.where(inside), self.symmetric and here["r"] == here["c"])

    def subset(self, r0: int, rn: int, c0: int, cn: int, eps: float | None = None) -> DataFrame:
        """Leaves (``LEAF``) cut to a rectangle in internal numbering; with ``eps`` low-rank ones are truncated again."""
        names = [x.split()[0] for x in LEAF.split(", ")]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for x in frame.itertuples():
                    rows, cols = (max(x.r_off, r0), min(x.r_off + x.r_n, r0 + rn)), (max(x.c_off, c0), min(x.c_off + x.c_n, c0 + cn))
                    i, j = slice(rows[0] - x.r_off, rows[1] - x.r_off), slice(cols[0] - x.c_off, cols[1] - x.c_off)
                    v = payload(x)
                    v = (v[0][i], v[1][j]) if isinstance(v, tuple) else v[i, j]
                    if isinstance(v, tuple) and eps is not None:
                        v = lowrank.truncate(v, eps)
                    row = {n: getattr(x, n) for n in names} | {"r_off": rows[0], "r_n": rows[1] - rows[0], "c_off": cols[0], "c_n": cols[1] - cols[0]}
                    out.append(row | packed(x, v))
                yield pd.DataFrame(out, columns=names)

        return self._meeting(r0, rn, c0, cn).select(names).mapInPandas(run, LEAF)

    def _meeting(self, r0: int, rn: int, c0: int, cn: int) -> DataFrame:
        return self.leaves.where((F.col("r_off") < r0 + rn) & (F.col("r_off") + F.col("r_n") > r0) & (F.col("c_off") < c0 + cn) & (F.col("c_off") + F.col("c_n") > c0))

    def diagonal_blocks(self, size: int) -> DataFrame:
        """(block, i, j, re, im) of the blocks of ``size`` x ``size`` positions on the diagonal; only leaves that meet them are expanded."""
        meets = (F.expr(f"(r_off div {size}L) <= ((c_off + c_n - 1) div {size}L)")) & F.expr(f"(c_off div {size}L) <= ((r_off + r_n - 1) div {size}L)")
        e = replace(self, leaves=self.leaves.where(meets))._entries_near(size)
        if self.symmetric:
            e = e.unionByName(e.select(F.col("col_pos").alias("row_pos"), F.col("row_pos").alias("col_pos"), "re", "im")).dropDuplicates(["row_pos", "col_pos"])
        return e.select(F.expr(f"row_pos div {size}L").alias("block"), (F.col("row_pos") % size).cast("int").alias("i"), (F.col("col_pos") % size).cast("int").alias("j"), "re", "im")

    def _entries_near(self, size: int) -> DataFrame:
        """``entries`` of the squares of ``size`` positions on the diagonal: a leaf gives its part of each square that it meets."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for x in frame.itertuples():
                    v = payload(x)
                    low, high = max(x.r_off, x.c_off) // size, min(x.r_off + x.r_n - 1, x.c_off + x.c_n - 1) // size
                    for k in range(int(low), int(high) + 1):
                        rows, cols = ((max(off, k * size), min(off + n, (k + 1) * size)) for off, n in ((x.r_off, x.r_n), (x.c_off, x.c_n)))
                        r, c = slice(rows[0] - x.r_off, rows[1] - x.r_off), slice(cols[0] - x.c_off, cols[1] - x.c_off)
                        m = dense_of((v[0][r], v[1][c])) if isinstance(v, tuple) else v[r, c]
                        i, j = np.indices(m.shape).reshape(2, -1)
                        yield pd.DataFrame({"row_pos": rows[0] + i, "col_pos": cols[0] + j, "re": m.real.ravel(), "im": m.imag.ravel() if np.iscomplexobj(m) else 0.0})

        return self.leaves.mapInPandas(run, "row_pos long, col_pos long, re double, im double")

    def checks(self) -> DataFrame:
        """One row: stored numbers, how many are zero and how many not finite, bytes, and whether all are zero."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for x in frame.itertuples():
                    parts = v if isinstance(v := payload(x), tuple) else (v,)
                    out.append({"stored": sum(p.size for p in parts), "zeros": sum(int((p == 0).sum()) for p in parts), "not_finite": sum(int((~np.isfinite(p)).sum()) for p in parts), "bytes": sum(len(b) for b in (x.a, x.b, x.d) if b is not None)})
                yield pd.DataFrame(out)

        kinds = "stored long, zeros long, not_finite long, bytes long"
        sums = self.leaves.mapInPandas(run, kinds).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("stored", "zeros", "not_finite", "bytes")])
        return sums.withColumn("all_zero", F.col("zeros") == F.col("stored"))

    def validated(self, kernel: Kernel) -> DataFrame:
        """Each low-rank leaf against the kernel's own block: r_off, c_off, rank, error and norm (Frobenius).

        The block's entries are evaluated again, a tile at a time. Rows (or columns) of equal coordinates and equal panel rows have equal
        entries on both sides, so they are held against each other once, times their number.
        """
        low = self.leaves.where("kind = 'rk'")
        rows, cols = (segments(perm, low.select(F.col(s).alias("path"))).select(F.col("path").alias(s), F.col("dofs").alias(f"{s}_dofs"), F.col("coords").alias(f"{s}_coords")) for perm, s in ((self.row_perm, "r"), (self.col_perm, "c")))
        by_place, parts = kernel._by_place, (kernel, *kernel.strata)

        def once(at: np.ndarray, ids: np.ndarray, panel: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            if not by_place:
                return at, ids, panel, np.ones(len(ids))
            real = np.concatenate([at, panel.real, panel.imag], axis=1) + 0.0
            _, first, number = np.unique(real, axis=0, return_index=True, return_counts=True)
            return at[first], ids[first], panel[first], number.astype(float)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for x in frame.itertuples():
                    sides = ((np.asarray(z, float).reshape(n, -1), np.asarray(ids)) for z, n, ids in ((x.r_coords, int(x.r_n), x.r_dofs), (x.c_coords, int(x.c_n), x.c_dofs)))
                    (p, i, a, u), (q, j, b, v) = (once(*side, panel) for side, panel in zip(sides, payload(x), strict=True))
                    error = norm = 0.0
                    step, wide_ = max(1, lowrank.TILE // len(j)), min(len(j), lowrank.TILE)
                    for at in range(0, len(i), step):
                        for to in range(0, len(j), wide_):
                            r, c = slice(at, at + step), slice(to, to + wide_)
                            m = sum(k.block(p[r], q[c], i[r], j[c]) for k in parts)
                            error += float(u[r] @ np.abs(a[r] @ b[c].T - m) ** 2 @ v[c])
                            norm += float(u[r] @ np.abs(m) ** 2 @ v[c])
                    out.append({"r_off": x.r_off, "c_off": x.c_off, "rank": x.rank, "error": error**0.5, "norm": norm**0.5})
                yield pd.DataFrame(out, columns=["r_off", "c_off", "rank", "error", "norm"])

        return low.join(rows, "r").join(cols, "c").mapInPandas(run, "r_off long, c_off long, rank int, error double, norm double")

    def full_gemm(self, x: DataFrame, **more) -> DataFrame:
        """X A for dense X, rows as right-hand sides."""
        return self.gemm_right(x, **more)

    def block(self, r0: int, rn: int, c0: int, cn: int) -> DataFrame:
        """Entries of a rectangle in internal numbering; leaves are cut to it before they are expanded."""
        return replace(self, leaves=self.subset(r0, rn, c0, cn)).entries()

    def diagonal(self) -> DataFrame:
        """(dof, re, im)."""
        hit = self.leaves.where((F.col("r_off") < F.col("c_off") + F.col("c_n")) & (F.col("c_off") < F.col("r_off") + F.col("r_n")))
        e = replace(self, leaves=hit).entries().where("row_pos = col_pos")
        return e.join(self.row_perm.select(F.col("pos").alias("row_pos"), "dof"), "row_pos").select("dof", "re", "im")

    def info(self) -> DataFrame:
        """One row of counts and sizes."""
        cells, rk = F.col("r_n") * F.col("c_n"), F.col("kind") == "rk"
        stored = F.when(rk, F.col("rank") * (F.col("r_n") + F.col("c_n"))).otherwise(cells)
        return self.leaves.agg(
            F.sum(rk.cast("long")).alias("rk_count"), F.sum((~rk).cast("long")).alias("full_count"),
            F.sum(F.when(rk, cells).otherwise(0)).alias("rk_size"), F.sum(F.when(~rk, cells).otherwise(0)).alias("full_size"),
            F.sum(stored).alias("compressed_size"), F.sum(cells).alias("uncompressed_size"),
            F.max("rank").alias("largest_rank"), F.max(F.when(~rk, F.greatest("r_n", "c_n"))).alias("largest_full_side"),
        )

    def profile(self) -> DataFrame:
        return self.leaves.groupBy("kind", "r_n", "c_n", "rank").agg(F.count(F.lit(1)).alias("blocks"))

    def norm(self) -> float:
        """Frobenius norm; stored halves count twice off the diagonal."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield pd.DataFrame([{"twice": x.r_off != x.c_off, "s": lowrank.norm_squared(v) if isinstance(v := payload(x), tuple) else float((np.abs(v) ** 2).sum())} for x in frame.itertuples()])

        weight = F.when(F.col("twice") & F.lit(self.symmetric), 2).otherwise(1)
        return float(self.leaves.mapInPandas(run, "twice boolean, s double").agg(F.sqrt(F.sum(weight * F.col("s")))).first()[0] or 0.0)

    def quantise(self, eps: float) -> tuple[HMatrix, DataFrame]:
        """Leaves stored as packed integers, and their bytes (``stored``) against those of plain numbers (``raw``) by kind.

        Low-rank leaves move by at most eps of their largest singular value, dense ones by eps of their norm (``bits``).  Products read them
        as they are; operators that change a leaf store it unpacked.
        """
        names = [x.split()[0] for x in LEAF.split(", ")]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for x in frame.itertuples():
                    v = payload(x)
                    row = {n: getattr(x, n) for n in names} | {"dtype": "Q" if x.dtype in COMPLEX else "P", "raw": sum(p.size * _NUM[_PACKED.get(x.dtype, x.dtype)]().nbytes for p in (v if isinstance(v, tuple) else (v,)))}
                    if isinstance(v, tuple):
                        a, b = bits.panels(v, eps)
                        row |= {"a": a, "b": b, "rank": int(np.frombuffer(a, np.int64, 2)[1]) // (2 if row["dtype"] == "Q" else 1)}
                    else:
                        row["d"] = bits.block(v, eps)
                    out.append(row)
                yield pd.DataFrame(out, columns=[*names, "raw"])

        small = settle(self.leaves.mapInPandas(run, LEAF + ", raw long"))
        stored = F.coalesce(F.length("d"), F.length("a") + F.length("b"))
        ratio = small.groupBy("kind").agg(F.sum("raw").alias("raw"), F.sum(stored).alias("stored"))
        return replace(self, leaves=small.drop("raw")), ratio

    # -------------------------------------------------------- products

    def _segments_of(self, x: DataFrame, perm: DataFrame, paths: DataFrame, side: str) -> DataFrame:
        """(side path, rhs[], re[], im[]) of vectors (dof, rhs, re[, im]) on the clusters ``paths``: all right-hand sides of a cluster in one row, by rhs and position."""
        if "im" not in x.columns:
            x = x.withColumn("im", F.lit(0.0))
        up = perm.join(x.hint("merge"), "dof").withColumn("path", F.explode(F.transform(F.sequence(F.lit(1), F.length("leaf")), lambda k: F.substring("leaf", F.lit(1), k)))).join(paths.distinct(), "path", "left_semi")
        s = F.sort_array(F.collect_list(F.struct("rhs", "pos", "re", "im")))
        return up.groupBy("path").agg(s.alias("s")).select(F.col("path").alias(side), F.col("s.rhs").alias("x_rhs"), F.col("s.re").alias("x_re"), F.col("s.im").alias("x_im"))

    def gemv(self, x: DataFrame, *, alpha: complex = 1, beta: complex = 0, y: DataFrame | None = None, op: str = "N") -> DataFrame:
        """alpha op(A) x + beta y for every right-hand side: (dof, rhs, re, im); op is N, T or C.

        Every leaf meets the piece of x on its columns; partial results are summed by position.
        """
        if op != "N":
            m = self.transpose()
            return (m.conjugate() if op == "C" else m).gemv(x, alpha=alpha, beta=beta, y=y)
        names = ["r", "c", "r_off", "r_n", "c_off", "c_n", "kind", "rank", "dtype", "a", "b", "d"]

        def times(turned: bool):
            def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for frame in frames:
                    out: list[tuple] = []
                    for z in frame.itertuples():
                        v = payload(z)
                        if turned:
                            v = (v[1], v[0]) if isinstance(v, tuple) else v.T
                        width = len(v[1]) if isinstance(v, tuple) else v.shape[1]
                        re, im = np.asarray(z.x_re, float), np.asarray(z.x_im, float)
                        piece = (re + 1j * im if im.any() else re).reshape(-1, width).T
                        y = v[0] @ (v[1].T @ piece) if isinstance(v, tuple) else v @ piece
                        y = (alpha * y).T  # a row for each right-hand side
                        pos = (z.c_off if turned else z.r_off) + np.arange(y.shape[1])
                        rhs = np.asarray(z.x_rhs)[::width]
                        out.append((np.tile(pos, len(rhs)), np.repeat(rhs, len(pos)), y.real.ravel(), y.imag.ravel() if np.iscomplexobj(y) else np.zeros(y.size)))
                    if out:
                        yield pd.DataFrame({n: np.concatenate(c) for n, c in zip(("pos", "rhs", "re", "im"), zip(*out), strict=True)})

            return run

        kind = "pos long, rhs int, re double, im double"
        leaves = self.leaves.select(names)
        cols = self._segments_of(x, self.col_perm, leaves.select(F.col("c").alias("path")), "c")
        parts = leaves.join(cols, "c").mapInPandas(times(False), kind)
        if self.symmetric:
            low = leaves.where("r_off <> c_off")
            rows = self._segments_of(x, self.row_perm, low.select(F.col("r").alias("path")), "r")
            parts = parts.unionByName(low.join(rows, "r").mapInPandas(times(True), kind))
        out = parts.groupBy("pos", "rhs").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
        out = out.join(self.row_perm.select("pos", "dof"), "pos").select("dof", "rhs", "re", "im")
        if y is not None and beta != 0:
            y = y if "im" in y.columns else y.withColumn("im", F.lit(0.0))
            b = complex(beta)
            more = y.select("dof", "rhs", (b.real * F.col("re") - b.imag * F.col("im")).alias("re"), (b.real * F.col("im") + b.imag * F.col("re")).alias("im"))
            out = out.unionByName(more).groupBy("dof", "rhs").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
        return out

    def gemm_right(self, x: DataFrame, **more) -> DataFrame:
        """X A for rows of X given as right-hand sides: A^T on each."""
        return self.gemv(x, op="T", **more)

    # -------------------------------------------------------- factors, products

    def factorize(self, kind: str = "lu", eps: float = 1e-12, strip_points: int | None = None, null_pivots: float = 0.0) -> Factor:
        """A kept factor: lu, llt, ldlt, hodlr or hodlrsym (real); see ``Factor``."""
        from .factor import Factor

        return Factor.of(self, kind, eps, strip_points, null_pivots)

    def solve(self, b: DataFrame, kind: str = "lu", part: str = "both", eps: float = 1e-12, null_pivots: float = 0.0) -> DataFrame:
        """x with A x = b through ``factorize``: once for this call; keep the factor to solve again."""
        return self.factorize(kind, eps, null_pivots=null_pivots).solve(b, part)

    def log_determinant(self, kind: str = "lu", eps: float = 1e-12) -> DataFrame:
        """One row: logdet (of A) and factor_logdet (of the stored triangular factor alone)."""
        return self.factorize(kind, eps).log_determinant()

    def inverse(self, eps: float = 1e-12, strip_points: int | None = None) -> HMatrix:
        """A^-1 in the structure of A, tile by tile from its LU factor; needs both halves."""
        if self.symmetric:
            raise ValueError("the inverse needs both halves of the matrix")

        f = self.factorize("lu", eps, strip_points)
        return replace(self, leaves=product.accumulate(self, f.inverse_parts(), eps, beta=0))

    def multiply(self, other: HMatrix, alpha: complex = 1, beta: complex = 0, into: HMatrix | None = None, op: tuple[str, str] = ("N", "N"), eps: float = 1e-12) -> HMatrix:
        """alpha op(A) op(B) + beta C as a matrix in the structure of C (default: that of A, with beta 0); op is N, T or C.

        The block trees of the three may differ, but not how they number points.  Symmetric A and B take part as a whole; C may be a lower half.
        """
        a, b = (product.unfolded(x) for x in (self, other))
        a, b = (x if o == "N" else x.transpose() if o == "T" else x.transpose().conjugate() for x, o in zip((a, b), op, strict=True))
        target = self if into is None else into
        return replace(target, leaves=product.multiply(a, b, target, alpha, beta, eps))

    def multiply_with_diagonal(self, d: DataFrame, side: str = "R", inverse: bool = False) -> HMatrix:
        """A D or D A (or with D^-1) for a diagonal given as (dof, re); one join of leaves with their piece of it."""
        perm, name = (self.col_perm, "c") if side == "R" else (self.row_perm, "r")
        pieces = self._segments_of(d.withColumn("rhs", F.lit(0)), perm, self.leaves.select(F.col(name).alias("path")), name)
        names = [x.split()[0] for x in LEAF.split(", ")]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for x in frame.itertuples():
                    v, s = payload(x), np.asarray(x.x_re, float)
                    s = 1 / s if inverse else s
                    if isinstance(v, tuple):
                        v = (v[0], v[1] * s[:, None]) if side == "R" else (v[0] * s[:, None], v[1])
                    else:
                        v = v * (s if side == "R" else s[:, None])
                    out.append({n: getattr(x, n) for n in names} | packed(x, v))
                yield pd.DataFrame(out, columns=names)

        return replace(self, leaves=self.leaves.join(pieces, name).mapInPandas(run, LEAF))

    def subtract_mdmt(self, m: HMatrix, d: DataFrame, n: HMatrix | None = None, eps: float = 1e-12) -> HMatrix:
        """self - M D N^T (N: M), D given as (dof, re)."""
        return m.multiply_with_diagonal(d).multiply(m if n is None else n, -1, 1, self, ("N", "T"), eps)

    def largest_eigenvalue(self, rounds: int = 20, seed: int = 0, start: DataFrame | None = None) -> float:
        """Power iteration with one distributed product per round, from ``start`` (dof, rhs 0, re) or a vector fixed by the seed."""
        x = start if start is not None else self.col_perm.select("dof", F.lit(0).alias("rhs"), (1 + F.pmod(F.xxhash64("dof", F.lit(seed)), F.lit(1000)) / 1000).alias("re"))
        value = 0.0
        for _ in range(rounds):
            size = x.agg(F.sqrt(F.sum(F.col("re") ** 2))).first()[0]
            x = self.gemv(x.withColumn("re", F.col("re") / size)).select("dof", "rhs", "re")
            x = cut(x)
            value = x.agg(F.sqrt(F.sum(F.col("re") ** 2))).first()[0]
        return value


def _window(*names: str):
    from pyspark.sql import Window

    return Window.partitionBy(*names)


def reordered(x: DataFrame, perm: DataFrame) -> DataFrame:
    """Vectors from user numbering (dof) to internal numbering (pos)."""
    return x.join(perm.select("pos", "dof"), "dof").drop("dof")


def restored(x: DataFrame, perm: DataFrame) -> DataFrame:
    """Vectors from internal numbering back to the user's."""
    return x.join(perm.select("pos", "dof"), "pos").drop("pos")
