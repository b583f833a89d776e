"""HODLR factors level by level: strips hold diagonal blocks and their part of every panel above them, nodes hold small systems.

A node p with children l, r and lower block A_rl = u v^T is diag(A_l, A_r) plus a matrix of rank 2k.  Bottom up, all nodes of a
level are alike: the strips multiply their pieces of the panels, the products are added up by node, each node solves its
small system, and the strips take the result up into the panels of the nodes above.  The number of levels is the
logarithm of the number of strips; no task holds more than a strip with its panels, or a node's small matrices.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import settle
from ..functions import dense, lowrank
from .strips import Vectors, basis, blob, doubles, each_row, matrix, numbers, places_of, prefixes, strips_of, summed, tree_qr

_LEAF = ["r", "c", "r_off", "r_n", "c_off", "c_n", "kind", "rank", "dtype", "a", "b", "d"]
_STATE = "strip string, n long, num long, kind string, node array<string>, side array<int>, rank array<int>, old array<int>, low binary, order binary, log double, w binary, y binary"
_CORE = "node string, depth int, kind string, r0 int, r1 int, core binary, order binary, log double"


def _inside(m, strips: DataFrame) -> DataFrame:
    """Lower leaves with the strip that holds them, if one does."""
    leaves = m.leaves.select(*_LEAF).where("r_off >= c_off")
    common = F.expr("case when r = c then r else substring(r, 1, greatest(0, array_min(transform(filter(sequence(1, length(r)), k -> substring(r, 1, k) <> substring(c, 1, k)), k -> k - 1)))) end")
    tagged = leaves.withColumn("common", common)
    of = tagged.select("r", "c", F.explode(prefixes("common")).alias("strip")).join(strips.select("strip"), "strip")
    return tagged.join(of, ["r", "c"], "left")


def factor(m, kind: str, strip_points: int, null_pivots: float = 0.0) -> dict[str, DataFrame]:
    """Tables of the factor: places, strips, panels and cores.  ``null_pivots``: see ``Factor``; for a core, whose diagonal is 1, it is the bound itself."""
    from .matrix import dense_of, payload

    strips = strips_of(m.row_nodes, strip_points)
    numbered = [(r["strip"], r["off"], r["n"], i) for i, r in enumerate(strips.orderBy("off").collect())]  # one row a strip
    strips = m.leaves.sparkSession.createDataFrame(numbered, "strip string, off long, n long, num long")
    tagged = _inside(m, strips)
    scalar = "Z" if (m.leaves.agg(F.max(F.col("dtype").isin("C", "Z", "Q"))).first()[0] or False) else "D"
    up = np.complex128 if scalar == "Z" else np.float64
    if kind == "hodlrsym" and scalar == "Z":
        raise ValueError("hodlrsym is for real matrices")
    top = tagged.where("strip is null").drop("strip")
    wrong = top.where("length(r) <> length(common) + 1 or length(c) <> length(common) + 1 or right(r, 1) <> '1' or right(c, 1) <> '0'").select("r", "c").first()
    if wrong is not None:
        raise ValueError(f"block {tuple(wrong)} is none of a HODLR matrix")

    # the blocks above the strips, cut to the strips
    under = strips.withColumn("node", F.explode(prefixes("strip"))).groupBy("node").agg(F.collect_list(F.struct("strip", "off", "n")).alias("list"))

    def slices(x):
        a, b = payload(x) if x.kind == "rk" else lowrank.svd(payload(x), 1e-15)
        for side, panel, off, held in ((1, a, x.r_off, x.r_list), (0, b, x.c_off, x.c_list)):
            for s in held:
                yield s["strip"], x.common, side, a.shape[1], blob(panel[s["off"] - off : s["off"] - off + s["n"]].astype(up))

    wide = top.join(under.select(F.col("node").alias("r"), F.col("list").alias("r_list")), "r").join(under.select(F.col("node").alias("c"), F.col("list").alias("c_list")), "c")
    panels = each_row(wide, slices, "strip string, node string, side int, rank int, w binary")

    def start(inner: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        first = inner.iloc[0]
        n, off = int(first["n"]), int(first["off"])
        out = np.zeros((n, n), up)
        for x in inner.itertuples():
            i, j = slice(x.r_off - off, x.r_off - off + x.r_n), slice(x.c_off - off, x.c_off - off + x.c_n)
            v = dense_of(payload(x))
            out[i, j] = v
            if x.r_off != x.c_off:
                out[j, i] = v.T
        above = above.sort_values("node", key=lambda s: s.str.len()) if len(above) else above
        w = np.concatenate([matrix(x.w, scalar, int(x.rank)) for x in above.itertuples() if x.rank] or [np.zeros((n, 0), up)], axis=1)
        least = null_pivots * np.abs(np.diag(out)).max(initial=0)
        if kind == "hodlr":
            low, order, log = dense.lu_or_pinv(out, least)
            y = dense.lu_solve((low, order), w)
        else:
            low, order = dense.llt(out, least), np.zeros(0, np.int64)
            y, log = dense.lower_solve(low, w), _log(low)
        ranks = [int(r) for r in above["rank"]] if len(above) else []
        row = {"strip": first["strip"], "n": n, "num": int(first["num"]), "kind": scalar, "node": list(above["node"]) if len(above) else [], "side": [int(s) for s in above["side"]] if len(above) else [], "rank": ranks, "old": ranks, "low": blob(low), "order": blob(order), "log": float(log), "w": blob(w), "y": blob(y)}
        return pd.DataFrame([row], columns=[c.split(" ")[0] for c in _STATE.split(", ")])

    inner = tagged.where("strip is not null").join(strips, "strip")
    state = settle(inner.groupBy("strip").cogroup(panels.groupBy("strip")).applyInPandas(start, _STATE))
    depths = [r[0] for r in top.select(F.length("common").alias("d")).distinct().orderBy(F.desc("d")).collect()]
    cores = None
    for depth in depths:
        state, more = _level(state, depth, kind, scalar, len(numbered), null_pivots)
        cores = more if cores is None else cores.unionByName(more)

    def spread(x):
        at = np.cumsum([0, *x.rank])
        was = np.cumsum([0, *x.old])
        n = int(x.n)
        w, y = matrix(x.w, scalar, int(was[-1])), matrix(x.y, scalar, int(at[-1]))
        for k in range(len(x.node)):
            left = y[:, at[k] : at[k + 1]] if kind == "hodlrsym" else w[:, was[k] : was[k + 1]]
            yield x.strip, x.node[k], len(x.node[k]), int(x.side[k]), n, int(x.rank[k]), scalar, blob(left), blob(y[:, at[k] : at[k + 1]])

    spark = state.sparkSession
    return {
        "places": settle(places_of(m.row_perm, strips)),
        "strips": settle(state.join(strips.select("strip", "off"), "strip").select("strip", "off", "n", "kind", "low", "order", "log")),
        "panels": settle(each_row(state, spread, "strip string, node string, depth int, side int, n long, rank int, kind string, left binary, right binary")),
        "cores": settle(cores) if cores is not None else spark.createDataFrame([], _CORE),
    }


def _log(low: np.ndarray) -> float:
    """log |det L L^T|."""
    with np.errstate(divide="ignore"):
        return float(2 * np.log(np.diag(low)).sum())


def _own(x, depth: int) -> int | None:
    """Which of a strip's panels belongs to its node of this depth."""
    return next((k for k, p in enumerate(x.node) if len(p) == depth), None)


def _level(state: DataFrame, depth: int, kind: str, scalar: str, count: int, null_pivots: float) -> tuple[DataFrame, DataFrame]:
    """Eliminates the nodes of one depth: the new state and the nodes' cores."""

    def products(x):
        k = _own(x, depth)
        if k is None:
            return
        at, was = np.cumsum([0, *x.rank]), np.cumsum([0, *x.old])
        y = matrix(x.y, scalar, int(at[-1])) if at[-1] else np.zeros((int(x.n), 0))
        own = y[:, at[k] : at[k + 1]]
        left = own if kind == "hodlrsym" else matrix(x.w, scalar, int(was[-1]))[:, was[k] : was[k + 1]]
        r = np.linalg.qr(own, mode="r") if kind == "hodlrsym" and own.shape[1] else own[:0]
        yield x.node[k], int(x.side[k]), int(x.num), scalar, own.shape[1], blob(r), doubles(left.T @ y[:, : at[k + 1]]), [int(v) for v in x.rank[: k + 1]]

    found = settle(each_row(state, products, "node string, side int, num long, kind string, columns int, r binary, g array<double>, ranks array<int>"))
    shape = found.groupBy("node", "side").agg(F.first("ranks").alias("ranks"))
    sums = shape.join(summed(found, ["node", "side"]), ["node", "side"], "left")
    if kind == "hodlrsym":
        sums = sums.join(tree_qr(found.where("columns > 0"), ["node", "side"], count).select("node", "side", "r"), ["node", "side"], "left")
    else:
        sums = sums.withColumn("r", F.lit(None).cast("binary"))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        by = {int(x.side): x for x in frame.itertuples()}
        ranks = [int(v) for v in by[0].ranks]
        k, own = ranks[-1], sum(ranks[:-1])
        g = [numbers(by[s].g, scalar, sum(ranks)) if k else np.zeros((0, sum(ranks))) for s in (0, 1)]
        if kind == "hodlr":
            core = np.eye(2 * k, dtype=g[0].dtype)
            core[:k, k:], core[k:, :k] = g[0][:, own:], g[1][:, own:]
            low, order, log = dense.lu_or_pinv(core, null_pivots)
            y = dense.lu_solve((low, order), np.concatenate([g[0][:, :own], g[1][:, :own]]))
            turn, add = [np.eye(k)] * 2, [-y[k:], -y[:k]]
        else:
            (b0, t0), (b1, t1) = (basis(matrix(by[s].r, scalar, k)) if k else (np.zeros((0, 0)),) * 2 for s in (0, 1))
            q, r = t0.shape[0], t1.shape[0]
            core = np.eye(q + r)
            core[q:, :q] = t1 @ t0.T
            core[:q, q:] = core[q:, :q].T
            low, order = dense.llt(core, null_pivots), np.zeros(0, np.int64)
            y = np.concatenate([b0.T @ g[0][:, :own], b1.T @ g[1][:, :own]])
            z = dense.lower_solve(low, y) - y
            turn, add = [b0, b1], [b0 @ z[:q], b1 @ z[q:]]
            log = _log(low)
        sizes = [t.shape[1] for t in turn]
        rows = [{"node": by[0].node, "side": s, "depth": depth, "kind": scalar, "r0": sizes[0], "r1": sizes[1], "core": blob(low), "order": blob(order), "log": float(log), "turn": blob(turn[s].astype(g[0].dtype)), "size": sizes[s], "add": blob(add[s])} for s in (0, 1)]
        return pd.DataFrame(rows)

    nodes = settle(sums.groupBy("node").applyInPandas(solve, "node string, side int, depth int, kind string, r0 int, r1 int, core binary, order binary, log double, turn binary, size int, add binary"))

    def update(x):
        k, y = _own(x, depth), x.y
        at, rank = np.cumsum([0, *x.rank]), [int(v) for v in x.rank]
        if k is not None and rank[k]:
            y = matrix(x.y, scalar, int(at[-1]))
            own, above = y[:, at[k] : at[k + 1]], y[:, : at[k]]
            if at[k]:
                above = above + own @ matrix(x.add, scalar, int(at[k]))
            mine = own @ matrix(x.turn, scalar, int(x.size)) if x.size else own[:, :0]
            y, rank[k] = blob(np.concatenate([above, mine, y[:, at[k + 1] :]], axis=1)), int(x.size)
        yield x.strip, x.n, x.num, x.kind, list(x.node), [int(v) for v in x.side], rank, [int(v) for v in x.old], x.low, x.order, x.log, x.w, y

    keyed = state.withColumn("own", F.get(F.filter(F.arrays_zip("node", "side"), lambda p: F.length(p["node"]) == depth), F.lit(0)))
    met = keyed.join(nodes.select(F.col("node").alias("o_node"), F.col("side").alias("o_side"), "turn", "size", "add"), (F.col("own.node") == F.col("o_node")) & (F.col("own.side") == F.col("o_side")), "left").drop("own", "o_node", "o_side")
    return settle(each_row(met, update, _STATE)), nodes.where("side = 0").select("node", "depth", "kind", "r0", "r1", "core", "order", "log")


def _swept(tables: dict[str, DataFrame], kind: str, v: Vectors, what: str) -> None:
    """One way through the factor: solve (Woodbury), or half_solve, half_solve_t, half_times, half_times_t with A = G G^T."""
    up = what in ("solve", "half_solve", "half_times_t")
    scalar, k = v.kind, len(v.ids)
    core_kind = tables["strips"].select("kind").first()["kind"]

    def local(x):
        n = int(x.n)
        low, b = matrix(x.low, core_kind, n), matrix(x.x, scalar, k)
        if what == "solve":
            b = dense.lu_solve((low, np.frombuffer(x.order, np.int64)), b)
        else:
            b = {"half_solve": lambda: dense.lower_solve(low, b), "half_solve_t": lambda: dense.upper_solve(low.T, b), "half_times": lambda: low @ b, "half_times_t": lambda: low.T @ b}[what]()
        yield x.strip, x.off, x.n, blob(b)

    def diagonal() -> None:
        v.table = settle(each_row(v.table.join(tables["strips"].select("strip", "kind", "low", "order"), "strip"), local, "strip string, off long, n long, x binary"))

    def gathered(x):
        yield x.node, x.side, doubles(matrix(x.left, core_kind, int(x.rank)).T @ matrix(x.x, scalar, k)) if x.rank else []

    def cores(frame: pd.DataFrame) -> pd.DataFrame:
        by = {int(x.side): x for x in frame.itertuples()}
        x = frame.iloc[0]
        r0, r1 = int(x["r0"]), int(x["r1"])
        y = np.concatenate([numbers(by[s].g, scalar, k) if r else np.zeros((0, k)) for s, r in ((0, r0), (1, r1))])
        core = matrix(x["core"], core_kind, r0 + r1)
        if what == "solve":
            z = dense.lu_solve((core, np.frombuffer(x["order"], np.int64)), y)
            add = [-z[r0:], -z[:r0]]
        else:
            z = {"half_solve": lambda: dense.lower_solve(core, y), "half_solve_t": lambda: dense.upper_solve(core.T, y), "half_times": lambda: core @ y, "half_times_t": lambda: core.T @ y}[what]() - y
            add = [z[:r0], z[r0:]]
        return pd.DataFrame([{"node": x["node"], "side": s, "add": blob(add[s].astype(np.complex128 if scalar == "Z" else np.float64))} for s in (0, 1)])

    def taken(x):
        b = matrix(x.x, scalar, k)
        if x.right is not None and x.rank:
            b = b + matrix(x.right, core_kind, int(x.rank)) @ matrix(x.add, scalar, k)
        yield x.strip, x.off, x.n, blob(b)

    depths = [r["depth"] for r in tables["cores"].where("r0 + r1 > 0").select("depth").distinct().orderBy(F.desc("depth") if up else "depth").collect()]
    if up:
        diagonal()
    for depth in depths:
        here = tables["panels"].where(F.col("depth") == depth)
        sums = summed(each_row(here.select("strip", "node", "side", "rank", "left").join(v.table, "strip"), gathered, "node string, side int, g array<double>"), ["node", "side"])
        mine = tables["cores"].where(F.col("depth") == depth).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
        solved = settle(mine.join(sums, ["node", "side"], "left").groupBy("node").applyInPandas(cores, "node string, side int, add binary"))
        more = here.select("strip", "node", "side", "rank", "right").join(solved, ["node", "side"]).drop("node", "side")
        v.table = settle(each_row(v.table.join(more, "strip", "left"), taken, "strip string, off long, n long, x binary"))
    if not up:
        diagonal()


def apply(tables: dict[str, DataFrame], kind: str, x: DataFrame, steps: list[str]) -> DataFrame:
    """The ways ``steps`` one after the other, in the users' numbering."""
    scalar = tables["strips"].select("kind").first()
    v = Vectors(x, tables["places"], tables["strips"], scalar["kind"] if scalar else "D")
    if v.ids:
        for step in steps:
            _swept(tables, kind, v, step)
    return v.rows(v.table)


def log_determinant(tables: dict[str, DataFrame]) -> DataFrame:
    logs = tables["strips"].select("log").unionByName(tables["cores"].select("log"))
    return logs.agg(F.coalesce(F.sum("log"), F.lit(0.0)).alias("logdet")).select("logdet", (F.col("logdet") / 2).alias("factor_logdet"))
