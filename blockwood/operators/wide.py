"""Blocks whose points no task holds: cross approximation over strips, and truncation of tall panels by a tree of QRs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import discard, settle
from ..functions import lowrank
from ..functions.dense import rank_by
from ..functions.kernels import Kernel
from .strips import basis, blob, doubles, each_row, matrix, prefixes, summed, tree_qr

# a strip of one side (0 rows, 1 columns) of a block with its piece of the panel so far; value: the last remainder, a number for each point
STRIP = "id string, side int, num long, off long, n long, dims int, rank int, kind string, dofs binary, coords binary, panel binary, value binary"
_NAMES = [x.split(" ")[0] for x in STRIP.split(", ")]
PANEL = "id string, side int, num long, off long, n long, rank int, kind string, panel binary"


def strips_of_blocks(blocks: DataFrame, row_perm: DataFrame, col_perm: DataFrame, points: int, kind: str) -> DataFrame:
    """Both sides of each block (id, r, c, r_off, c_off) cut into runs of ``points`` positions."""
    out = None
    for side, perm, path, off in ((0, row_perm, "r", "r_off"), (1, col_perm, "c", "c_off")):
        held = perm.withColumn("path", F.explode(prefixes("leaf"))).join(blocks.select("id", F.col(path).alias("path"), F.col(off).alias("begin")), "path")
        cells = held.select("id", F.lit(side).alias("side"), F.expr(f"(pos - begin) div {points}L").alias("num"), F.struct("pos", "dof", "coord").alias("p"))
        rows = cells.groupBy("id", "side", "num").agg(F.sort_array(F.collect_list("p")).alias("p"))
        out = rows if out is None else out.unionByName(rows)

    def pack(x):
        coords = np.array([list(p["coord"]) for p in x.p], float)
        yield x.id, x.side, x.num, x.p[0]["pos"], len(x.p), coords.shape[1], 0, kind, blob(np.array([p["dof"] for p in x.p], np.int64)), blob(coords), b"", b""

    return settle(each_row(out, pack, STRIP))


def _panel(x) -> np.ndarray:
    return matrix(x.panel, x.kind, int(x.rank)) if x.rank else np.zeros((int(x.n), 0), complex if x.kind == "Z" else float)


def _point(x, i: int) -> tuple:
    """What the other side needs to know of a point: position, dof, coordinates, its row of the panel."""
    row = _panel(x)[i]
    return int(x.off + i), int(np.frombuffer(x.dofs, np.int64)[i]), matrix(x.coords, "D", int(x.dims))[i].tolist(), doubles(row)


_POINT = "id string, pos long, dof long, coord array<double>, row array<double>, size double, re double, im double"


def _points_at(state: DataFrame, places: dict[str, int]) -> dict[str, dict]:
    """Row points of blocks by position."""

    def find(x):
        i = places.get(x.id, -1) - x.off
        if x.side == 0 and 0 <= i < x.n:
            yield (x.id, *_point(x, int(i)), 0.0, 0.0, 0.0)

    return {r["id"]: r.asDict() for r in each_row(state.where("side = 0"), find, _POINT).collect()}  # one point a block


def _advanced(state: DataFrame, side: int, kernel: Kernel, pivots: dict[str, dict], used: dict[str, list[int]]) -> tuple[DataFrame, dict[str, dict], dict[str, np.ndarray]]:
    """Remainders of the pivots' rows (side 1) or columns (side 0) on all strips of that side, and where they are largest.

    Also the products of the new remainder with the panel's columns and with itself, added up by block.
    """

    def step(x):
        if x.side != side or x.id not in pivots:
            yield tuple(getattr(x, n) for n in _NAMES) + (None, None, None)
            return
        p = pivots[x.id]
        old = _panel(x)
        at, dofs = matrix(x.coords, "D", int(x.dims)), np.frombuffer(x.dofs, np.int64)
        one, who = np.array([p["coord"]]), np.array([p["dof"]])
        v = kernel.block(at, one, dofs, who)[:, 0] if side == 0 else kernel.block(one, at, who, dofs)[0]
        kind = complex if x.kind == "Z" else float
        row = np.asarray(p["row"], float).view(kind)
        v = (v - old @ row[: old.shape[1]]).astype(kind)
        free = np.ones(len(v), bool)
        if side == 0:
            taken = np.array(used[x.id], np.int64) - x.off
            free[taken[(taken >= 0) & (taken < len(v))]] = False
        best = None
        if free.any():
            i = int(np.argmax(np.where(free, np.abs(v), -1)))
            best = (*_point(x, i), float(abs(v[i])), float(v[i].real), float(v[i].imag) if kind is complex else 0.0)
        sums = doubles(np.concatenate([old.conj().T @ v, [np.vdot(v, v)]]))
        yield (*(getattr(x, n) for n in _NAMES[:-1]), blob(v), None if best is None else {k: b for k, b in zip(_POINT_NAMES[1:], best, strict=True)}, None if best is None else best[4], sums)

    schema = STRIP + ", best struct<pos: long, dof: long, coord: array<double>, row: array<double>, size: double, re: double, im: double>, size double, sums array<double>"
    names = [*_NAMES, "best", "size", "sums"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([y for x in frame.itertuples() for y in step(x)], columns=names)

    new = settle(state.mapInPandas(run, schema))
    here = new.where((F.col("side") == side) & F.col("id").isin(list(pivots)))
    best = {r["id"]: r["best"].asDict() for r in here.where("best is not null").groupBy("id").agg(F.max_by("best", F.struct("size", -F.col("off"))).alias("best")).collect()}
    kind = new.select("kind").first()["kind"]
    sums = {r["id"]: np.asarray(r["sums"], float).view(complex if kind == "Z" else float) for r in summed(here.select("id", "sums"), ["id"], "sums").collect()}
    return new.drop("best", "size", "sums"), best, sums


_POINT_NAMES = [x.split(" ")[0] for x in _POINT.replace("array<double>", "a").split(", ")]


def _joined(state: DataFrame, columns: dict[str, complex]) -> DataFrame:
    """The last remainders become columns of the panels of those blocks (of side 1 divided by the pivot)."""

    def run(x):
        if x.id not in columns:
            yield tuple(getattr(x, n) for n in _NAMES)
            return
        v = np.frombuffer(x.value, complex if x.kind == "Z" else float)
        panel = np.concatenate([_panel(x), (v / columns[x.id] if x.side == 1 else v)[:, None]], axis=1)
        yield (*(getattr(x, n) for n in _NAMES[:6]), panel.shape[1], *(getattr(x, n) for n in _NAMES[7:10]), blob(panel), b"")

    return settle(each_row(state, run, STRIP))


def cross_approximation(blocks: DataFrame, row_perm: DataFrame, col_perm: DataFrame, kernel: Kernel, eps: float, points: int = 10_000, kind: str = "D") -> DataFrame:
    """Panels (``PANEL``) of blocks (id, r, c, r_off, r_n, c_off, c_n), compressed with ``points`` points of a block in a task.

    Cross approximation with partial pivoting on all blocks at once: the remainder of the pivot row is taken on every strip of
    columns, its largest entry names the pivot column, whose remainder on the strips of rows names the next row.  The driver
    sees one point and a few sums of each block in a round.  A block is done after two small crosses in a row, or
    when the remainders of eight rows in a row, evenly spread, are zero.  The panels are truncated to ``eps`` at the end.
    """
    if kernel.strata:
        raise NotImplementedError("strata of blocks beyond a task")
    heads = {r["id"]: r.asDict() for r in blocks.select("id", "r_off", "r_n", "c_n").collect()}
    state = strips_of_blocks(blocks, row_perm, col_perm, points, kind)
    used: dict[str, list[int]] = {i: [] for i in heads}
    size, top = dict.fromkeys(heads, 0.0), dict.fromkeys(heads, 0.0)
    small, rank, tries = dict.fromkeys(heads, 0), dict.fromkeys(heads, 0), dict.fromkeys(heads, 0)
    pivots = _points_at(state, {i: int(h["r_off"]) for i, h in heads.items()})
    while pivots:
        for i, p in pivots.items():
            used[i].append(p["pos"])
        old = state
        state, best, row_sums = _advanced(state, 1, kernel, pivots, used)
        discard(old)
        live = {i: b for i, b in best.items() if b["size"] > 1e-15 * top[i]}
        scale = {i: complex(b["re"], b["im"]) if kind == "Z" else b["re"] for i, b in live.items()}
        following: dict[str, dict] = {}
        if live:
            for i, b in live.items():
                top[i], tries[i] = max(top[i], b["size"]), 0
            old = state
            state, next_rows, col_sums = _advanced(state, 0, kernel, live, used)
            discard(old)
            grown = {}
            for i in live:
                u, v = col_sums[i], row_sums[i] / scale[i]
                uu, vv = abs(u[-1]), abs(v[-1] / np.conj(scale[i]))
                tiny = rank[i] > 0 and np.sqrt(uu * vv) <= eps * np.sqrt(max(size[i], 0))
                small[i] = small[i] + 1 if tiny else 0
                if not tiny:
                    size[i] += 2 * float((u[:-1] * v[:-1]).sum().real) + uu * vv
                    rank[i] += 1
                    grown[i] = scale[i]
                if small[i] < 2 and rank[i] < min(heads[i]["r_n"], heads[i]["c_n"]) and i in next_rows:
                    following[i] = next_rows[i]
            if grown:
                old = state
                state = _joined(state, grown)
                discard(old)
        again = {}
        for i in set(pivots) - set(live):  # a row that is zero, as repeated points have them: another one, far from it
            tries[i] += 1
            n = int(heads[i]["r_n"])
            other = next((k for t in range(n) if (k := int(heads[i]["r_off"]) + (tries[i] * n // 8 + t) % n) not in used[i]), None)
            if tries[i] < 8 and other is not None and rank[i] < min(n, heads[i]["c_n"]):
                again[i] = other
        places = {i: int(p["pos"]) for i, p in following.items()} | again
        pivots = _points_at(state, places) if places else {}
    panels = state.select(*[x.split(" ")[0] for x in PANEL.split(", ")])
    return truncated(panels, eps)


def truncated(panels: DataFrame, eps: float) -> DataFrame:
    """Panels a, b (side 0 and 1 of an id) in strips, cut so that a b^T keeps its singular values above ``eps`` of the largest.

    R factors of the strips are stacked and factored again in a tree; a task then holds two small factors, and each strip is multiplied by a small matrix.
    """

    def r_factor(x):
        if x.rank:
            yield x.id, x.side, x.num, x.kind, int(x.rank), blob(np.linalg.qr(matrix(x.panel, x.kind, int(x.rank)), mode="r"))

    small = settle(each_row(panels, r_factor, "id string, side int, num long, kind string, columns int, r binary"))
    most = small.agg(F.max("num")).first()[0]
    if most is None:
        return panels

    def middle(frame: pd.DataFrame) -> pd.DataFrame:
        by = {int(x.side): matrix(x.r, x.kind, int(x.columns)) for x in frame.itertuples()}
        (ba, ta), (bb, tb) = basis(by[0], 1e-300), basis(by[1], 1e-300)
        u, s, vt = np.linalg.svd(ta @ tb.T, full_matrices=False)
        k = rank_by(s, eps)
        root = np.sqrt(s[:k])
        kind = frame["kind"].iloc[0]
        up = complex if kind == "Z" else float
        return pd.DataFrame([(frame["id"].iloc[0], side, k, blob(m.astype(up))) for side, m in ((0, ba @ (u[:, :k] * root)), (1, bb @ (vt[:k].T * root)))], columns=["id", "side", "cut", "turn"])

    turns = settle(tree_qr(small, ["id", "side"], most + 1).groupBy("id").applyInPandas(middle, "id string, side int, cut int, turn binary"))

    def turn(x):
        k = 0 if x.turn is None else int(x.cut)
        yield x.id, x.side, x.num, x.off, x.n, k, x.kind, blob(matrix(x.panel, x.kind, int(x.rank)) @ matrix(x.turn, x.kind, k)) if k and x.rank else b""

    return settle(each_row(panels.join(turns, ["id", "side"], "left"), turn, PANEL))


def leaves_of(panels: DataFrame, blocks: DataFrame, eps: float, scalar: str) -> DataFrame:
    """Compressed blocks as leaves (a row each, below 2 GB)."""
    from .matrix import _NUM, LEAF

    cells = panels.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("side", "num", "panel"))).alias("s"), F.max("rank").alias("k"), F.first("kind").alias("num"))
    met = blocks.join(cells, "id")
    up = _NUM[scalar]

    def run(x):
        a, b = (np.concatenate([np.frombuffer(p["panel"], complex if x.num == "Z" else float) for p in x.s if p["side"] == side]).astype(up) for side in (0, 1))
        yield x.r, x.c, x.r_off, x.r_n, x.c_off, x.c_n, "rk", int(x.k), eps, scalar, blob(a), blob(b), None

    return each_row(met, run, LEAF)
