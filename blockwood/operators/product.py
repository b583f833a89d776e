"""Sums of blocks that lie anywhere, and products of two matrices, as joins of leaves by cluster.

Two leaves meet if their clusters do, and clusters of one tree meet if one's path begins the other's.  A product's low-rank pieces are kept as
panels along whole clusters: a leaf's panel goes once through the leaves of the other matrix that lie inside its cluster, so
what is moved is in proportion to the leaves that overlap, and only then cut to the leaves of the result.
"""

from __future__ import annotations

from types import SimpleNamespace
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import cut, settle
from ..functions import lowrank
from .strips import blob, each_row, matrix, prefixes

if TYPE_CHECKING:
    from .matrix import HMatrix

# a block anywhere: rank -1 and a dense array in a, or panels a (r_n x rank) and b (c_n x rank)
PART = "id string, r_off long, r_n long, c_off long, c_n long, rank int, kind string, a binary, b binary"
_PART = [x.split(" ")[0] for x in PART.split(", ")]
_LEAF = ["r", "c", "r_off", "r_n", "c_off", "c_n", "kind", "rank", "dtype", "a", "b", "d"]


def _kind(*x: np.ndarray) -> str:
    return "Z" if any(np.iscomplexobj(v) for v in x) else "D"


def part(name: str, r_off: int, c_off: int, v) -> tuple:
    if isinstance(v, tuple):
        k = _kind(*v)
        up = np.complex128 if k == "Z" else np.float64
        return name, int(r_off), len(v[0]), int(c_off), len(v[1]), v[0].shape[1], k, blob(v[0].astype(up)), blob(v[1].astype(up))
    return name, int(r_off), v.shape[0], int(c_off), v.shape[1], -1, _kind(v), blob(v), None


def part_value(x):
    if x.rank < 0:
        return matrix(x.a, x.kind, int(x.c_n))
    kind = np.complex128 if x.kind == "Z" else np.float64
    return np.frombuffer(x.a, kind).reshape(int(x.r_n), int(x.rank)), np.frombuffer(x.b, kind).reshape(int(x.c_n), int(x.rank))


def common_prefix(a: str, b: str) -> F.Column:
    same = F.expr(f"filter(sequence(1, least(length({a}), length({b}))), k -> substring({a}, 1, k) = substring({b}, 1, k))")
    return F.substring(F.col(a), F.lit(1), F.array_max(same))


def meetings(target: HMatrix, boxes: DataFrame) -> DataFrame:
    """(id, r, c): which leaves of ``target`` each box (id, r_off, r_n, c_off, c_n; none empty) meets.

    A box is known by the smallest clusters that hold its rows and its columns; leaves that meet it lie inside those, around
    them, or inside one and around the other: four equi-joins of paths, then the intervals decide.
    """
    ends = boxes.select("id", "r_off", "r_n", "c_off", "c_n")
    for perm, off, n, to in ((target.row_perm, "r_off", "r_n", "pr"), (target.col_perm, "c_off", "c_n", "pc")):
        places = perm.select("pos", "leaf")
        ends = ends.join(places.select(F.col("pos").alias(off), F.col("leaf").alias("first")), off)
        ends = ends.withColumn("last_pos", F.col(off) + F.col(n) - 1).join(places.select(F.col("pos").alias("last_pos"), F.col("leaf").alias("last")), "last_pos")
        ends = ends.withColumn(to, common_prefix("first", "last")).drop("first", "last", "last_pos")
    box = cut(ends)
    leaves = target.blocks.where("kind <> 'node'").select("r", "c", F.col("r_off").alias("l_ro"), F.col("r_n").alias("l_rn"), F.col("c_off").alias("l_co"), F.col("c_n").alias("l_cn"))
    up = lambda p: F.explode(prefixes(p))
    above = lambda p: F.explode(F.slice(prefixes(p), F.lit(1), F.length(p) - 1))
    out = None
    for inside_r in (True, False):
        for inside_c in (True, False):
            mine = leaves.withColumn("x", up("r") if inside_r else F.col("r")).withColumn("y", up("c") if inside_c else F.col("c"))
            theirs = box.withColumn("x", F.col("pr") if inside_r else above("pr")).withColumn("y", F.col("pc") if inside_c else above("pc"))
            met = theirs.join(mine, ["x", "y"])
            out = met if out is None else out.unionByName(met)
    overlap = (F.col("r_off") < F.col("l_ro") + F.col("l_rn")) & (F.col("l_ro") < F.col("r_off") + F.col("r_n")) & (F.col("c_off") < F.col("l_co") + F.col("l_cn")) & (F.col("l_co") < F.col("c_off") + F.col("c_n"))
    return out.where(overlap).select("id", "r", "c", "l_ro", "l_rn", "l_co", "l_cn")


def _embedded(x, v, eps: float) -> lowrank.Rk:
    """A slice as panels of the whole leaf."""
    a, b = v if isinstance(v, tuple) else lowrank.svd(v, eps)
    if len(a) == x.l_rn and len(b) == x.l_cn:
        return a, b
    big_a, big_b = np.zeros((int(x.l_rn), a.shape[1]), a.dtype), np.zeros((int(x.l_cn), b.shape[1]), b.dtype)
    big_a[x.r_off - x.l_ro : x.r_off - x.l_ro + x.r_n], big_b[x.c_off - x.l_co : x.c_off - x.l_co + x.c_n] = a, b
    return big_a, big_b


def _sum(frame: pd.DataFrame, low: bool, eps: float):
    """Slices of one leaf added up: low rank (cut whenever twice the leaf's lesser side is reached), or dense."""
    first = frame.iloc[0]
    shape = int(first["l_rn"]), int(first["l_cn"])
    if not low:
        full = np.zeros(shape, complex if (frame["kind"] == "Z").any() else float)
        for x in frame.itertuples():
            v = part_value(x)
            full[x.r_off - x.l_ro : x.r_off - x.l_ro + x.r_n, x.c_off - x.l_co : x.c_off - x.l_co + x.c_n] += v[0] @ v[1].T if isinstance(v, tuple) else v
        return full
    held, rank = [], 0
    for x in frame.itertuples():
        held.append((1, _embedded(x, part_value(x), eps)))
        rank += held[-1][1][0].shape[1]
        if rank > 2 * max(16, min(shape)):
            held = [(1, lowrank.add(held, eps))]
            rank = held[0][1][0].shape[1]
    return lowrank.truncate((np.concatenate([v[0] for _, v in held], 1), np.concatenate([v[1] for _, v in held], 1)), eps)


def accumulate(target: HMatrix, parts: DataFrame, eps: float, beta: complex = 1, fan: int = 16) -> DataFrame:
    """Leaves of beta * target + sum of ``parts``, in the structure of ``target``.

    Parts are cut to the leaves they meet; the slices of a leaf are added in groups of ``fan`` and truncated, round by round, and then to the leaf.
    """
    from .matrix import LEAF, packed, payload

    parts = settle(parts.where("r_n > 0 and c_n > 0 and rank <> 0"))
    met = cut(meetings(target, parts))
    lists = met.groupBy("id").agg(F.collect_list(F.struct("r", "c", "l_ro", "l_rn", "l_co", "l_cn")).alias("list"))

    def slices(x):
        v = part_value(x)
        for leaf in x.list:
            r0, r1 = max(x.r_off, leaf["l_ro"]), min(x.r_off + x.r_n, leaf["l_ro"] + leaf["l_rn"])
            c0, c1 = max(x.c_off, leaf["l_co"]), min(x.c_off + x.c_n, leaf["l_co"] + leaf["l_cn"])
            i, j = slice(r0 - x.r_off, r1 - x.r_off), slice(c0 - x.c_off, c1 - x.c_off)
            yield (*part(x.id, r0, c0, (v[0][i], v[1][j]) if isinstance(v, tuple) else np.ascontiguousarray(v[i, j])), leaf["r"], leaf["c"], leaf["l_ro"], leaf["l_rn"], leaf["l_co"], leaf["l_cn"])

    place = "r string, c string, l_ro long, l_rn long, l_co long, l_cn long"
    cut_ = each_row(parts.join(lists, "id"), slices, f"{PART}, {place}")
    shapes = target.leaves.select("r", "c", F.col("kind").alias("l_kind"))
    most = met.groupBy("r", "c").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        x = frame.iloc[0]
        v = _sum(frame, x["l_kind"] == "rk", eps)
        row = (*part(x["id"], x["l_ro"], x["l_co"], v), *[x[c] for c in ("r", "c", "l_ro", "l_rn", "l_co", "l_cn", "l_kind")])
        return pd.DataFrame([row], columns=[*_PART, "r", "c", "l_ro", "l_rn", "l_co", "l_cn", "l_kind"])

    cut_ = cut_.join(shapes, ["r", "c"])
    while most > fan:
        most = -(-most // fan)
        cut_ = cut_.withColumn("_g", F.pmod(F.xxhash64("id", "r_off", "c_off", F.lit(most)), F.lit(most))).groupBy("r", "c", "_g").applyInPandas(merged, f"{PART}, {place}, l_kind string")

    names = [x.split(" ")[0] for x in LEAF.split(", ")]

    def taken(leaf: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        if not len(leaf):
            return pd.DataFrame(columns=names)
        x = SimpleNamespace(**leaf.iloc[0].to_dict())
        row = {n: getattr(x, n) for n in names}
        v = payload(x)
        if beta == 0:
            v = lowrank.zero_rk(int(x.r_n), int(x.c_n)) if isinstance(v, tuple) else 0 * v
        elif beta != 1:
            v = (beta * v[0], v[1]) if isinstance(v, tuple) else beta * v
        if len(more):
            w = _sum(more, isinstance(v, tuple), eps)
            v = (lowrank.add([(1, v), (1, w)], eps) if v[0].shape[1] else w) if isinstance(v, tuple) else v + w
        return pd.DataFrame([row | packed(x, v)], columns=names)

    return settle(target.leaves.groupBy("r", "c").cogroup(cut_.drop("l_kind").groupBy("r", "c")).applyInPandas(taken, LEAF))


def parts_of(m: HMatrix, alpha: complex = 1) -> DataFrame:
    """The leaves of a matrix as parts, missing halves mirrored."""
    from .matrix import payload

    def run(x):
        v = payload(x)
        v = (alpha * v[0], v[1]) if isinstance(v, tuple) else alpha * v
        yield part(f"{x.r}:{x.c}", x.r_off, x.c_off, v)

    return each_row(unfolded(m).leaves.select(_LEAF), run, PART)


def unfolded(m: HMatrix) -> HMatrix:
    """The same matrix with both halves stored."""
    from dataclasses import replace

    if not m.symmetric:
        return m
    low = replace(m, leaves=m.leaves.where("r_off <> c_off"))
    return replace(m, leaves=m.leaves.unionByName(low.transpose().leaves), symmetric=False)


def _slices(leaves: DataFrame, side: str, clusters: DataFrame, strict: bool) -> DataFrame:
    """(leaf columns, at, data): panels (or dense arrays) of leaves cut along their ``side`` cluster to those ``clusters`` (path, off, n) that lie inside it."""
    from .matrix import payload

    inside = F.explode(F.slice(prefixes("path"), F.lit(1), F.length("path") - 1)) if strict else F.explode(prefixes("path"))
    lists = clusters.withColumn("holder", inside).groupBy("holder").agg(F.collect_list(F.struct("path", "off", "n")).alias("list"))
    met = leaves.join(lists, F.col(side) == F.col("holder")).drop("holder")

    def run(x):
        v = payload(x)
        off = x.c_off if side == "c" else x.r_off
        for k in x.list:
            cut = slice(k["off"] - off, k["off"] - off + k["n"])
            data = v[1 if side == "c" else 0][cut] if isinstance(v, tuple) else v[:, cut] if side == "c" else v[cut]
            yield x.r, x.c, x.r_off, x.r_n, x.c_off, x.c_n, x.kind, k["path"], data.shape[1], _kind(data), blob(data)

    names = [f"{n} {t}" for n, t in (("s_r", "string"), ("s_c", "string"), ("s_ro", "long"), ("s_rn", "long"), ("s_co", "long"), ("s_cn", "long"), ("s_kind", "string"), ("at", "string"), ("s_k", "int"), ("s_num", "string"), ("s_data", "binary"))]
    return each_row(met, run, ", ".join(names))


_PIECE = "side string, r string, c string, r_off long, c_off long, n long, k int, num string, data binary"


def multiply(a: HMatrix, b: HMatrix, target: HMatrix, alpha: complex, beta: complex, eps: float) -> DataFrame:
    """Leaves of alpha A B + beta C in the structure of C.

    Leaves of A and B that meet in the middle, the larger cluster deciding: a low-rank leaf of A goes through the leaves
    of B inside its columns (a b^T B = a (B^T b)^T), one of B through the leaves of A inside its rows, dense ones multiply.
    """
    from .matrix import payload

    clash = a.col_nodes.select("path", "off", "n").join(b.row_nodes.select("path", F.col("off").alias("o"), F.col("n").alias("m")), "path").where("off <> o or n <> m").limit(1).count()
    if clash or a._order_of(a.col_perm, b.row_perm) or a._order_of(a.row_perm, target.row_perm) or a._order_of(b.col_perm, target.col_perm):
        raise ValueError("the matrices number or cut their points differently")
    left, right = unfolded(a).leaves.select(_LEAF), unfolded(b).leaves.select(_LEAF)
    k_right = right.select(F.col("r").alias("path"), F.col("r_off").alias("off"), F.col("r_n").alias("n")).distinct()
    k_left = left.select(F.col("c").alias("path"), F.col("c_off").alias("off"), F.col("c_n").alias("n")).distinct()

    def within_a(x):  # a slice of A's leaf with a whole leaf of B
        s, v = matrix(x.s_data, x.s_num, int(x.s_k)), payload(x)
        if x.s_kind == "rk":
            t = v[1] @ (v[0].T @ s) if isinstance(v, tuple) else v.T @ s
            yield "A", x.s_r, x.s_c, 0, x.c_off, len(t), t.shape[1], _kind(t), blob(t)
        elif isinstance(v, tuple):
            t = s @ v[0]
            yield "B", x.r, x.c, x.s_ro, 0, len(t), t.shape[1], _kind(t), blob(t)
        else:
            t = s @ v
            yield "D", x.s_r, x.c, x.s_ro, x.c_off, len(t), t.shape[1], _kind(t), blob(t)

    def within_b(x):  # a whole leaf of A with a slice of B's leaf
        s, v = matrix(x.s_data, x.s_num, int(x.s_k)), payload(x)
        if x.s_kind == "rk":
            t = v[0] @ (v[1].T @ s) if isinstance(v, tuple) else v @ s
            yield "B", x.s_r, x.s_c, x.r_off, 0, len(t), t.shape[1], _kind(t), blob(t)
        elif isinstance(v, tuple):
            t = s.T @ v[1]
            yield "A", x.r, x.c, 0, x.s_co, len(t), t.shape[1], _kind(t), blob(t)
        else:
            t = v @ s
            yield "D", x.r, x.s_c, x.r_off, x.s_co, len(t), t.shape[1], _kind(t), blob(t)

    empty = lambda x: F.col("rank").isNull() | (F.col("rank") > 0)
    left, right = left.where(empty(left)), right.where(empty(right))
    one = each_row(_slices(left, "c", k_right, False).join(right, F.col("at") == F.col("r")), within_a, _PIECE)
    two = each_row(_slices(right, "r", k_left, True).join(left, F.col("at") == F.col("c")), within_b, _PIECE)
    pieces = settle(one.unionByName(two))

    def spanned(frame: pd.DataFrame, off: str) -> tuple[int, np.ndarray]:
        begin, end = int(frame[off].min()), int((frame[off] + frame["n"]).max())
        out = np.zeros((end - begin, int(frame["k"].iloc[0])), complex if (frame["num"] == "Z").any() else float)
        for x in frame.itertuples():
            at = getattr(x, off) - begin
            out[at : at + x.n] += matrix(x.data, x.num, int(x.k))
        return begin, out

    def through(side: str):
        def run(leaf: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
            if not len(leaf) or not len(frame):
                return pd.DataFrame(columns=_PART)
            x = SimpleNamespace(**leaf.iloc[0].to_dict())
            v = payload(x)
            begin, t = spanned(frame, "c_off" if side == "A" else "r_off")
            made = part(f"A{x.r}:{x.c}", x.r_off, begin, (alpha * v[0], t)) if side == "A" else part(f"B{x.r}:{x.c}", begin, x.c_off, (alpha * t, v[1]))
            return pd.DataFrame([made], columns=_PART)

        return run

    def dense(frame: pd.DataFrame) -> pd.DataFrame:
        x = frame.iloc[0]
        v = alpha * sum(matrix(d, n, int(k)) for d, n, k in zip(frame["data"], frame["num"], frame["k"], strict=True))
        return pd.DataFrame([part(f"D{x['r']}:{x['c']}", x["r_off"], x["c_off"], v)], columns=_PART)

    keys = ["r", "c"]
    parts = left.where("kind = 'rk'").groupBy(*keys).cogroup(pieces.where("side = 'A'").groupBy(*keys)).applyInPandas(through("A"), PART)
    parts = parts.unionByName(right.where("kind = 'rk'").groupBy(*keys).cogroup(pieces.where("side = 'B'").groupBy(*keys)).applyInPandas(through("B"), PART))
    parts = parts.unionByName(pieces.where("side = 'D'").groupBy(*keys).applyInPandas(dense, PART))
    return accumulate(target, parts, eps, beta)
