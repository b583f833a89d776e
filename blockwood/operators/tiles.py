"""LU, LLt and LDLt of matrices cut into tiles, and triangular solves by waves of tiles.

Rows and columns are cut into the same strips; a tile is dense or low rank and fits a task.  The factorization goes
over the strips in order, one at a time: the tiles of a column (and row) that were finished before are joined on what they share, their products are
added up, the diagonal tile is factored and the others are solved with it.  Finished tiles are written once and never changed.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import settle
from ..functions import dense, lowrank
from .strips import Vectors, blob, each_row, matrix, places_of, prefixes, strips_of

TILE = "i int, j int, rows int, cols int, rank int, kind string, a binary, b binary, order binary, diag binary"
_NAMES = [x.split(" ")[0] for x in TILE.split(", ")]
_MOST_TILES = 4_000_000
Value = np.ndarray | lowrank.Rk


def tile(i: int, j: int, v: Value, kind: str, order: np.ndarray | None = None, diag: np.ndarray | None = None) -> tuple:
    up = np.complex128 if kind == "Z" else np.float64
    extra = (None if order is None else blob(order), None if diag is None else blob(diag.astype(up)))
    if isinstance(v, tuple):
        return (i, j, len(v[0]), len(v[1]), v[0].shape[1], kind, blob(v[0].astype(up)), blob(v[1].astype(up)), *extra)
    return (i, j, *v.shape, -1, kind, blob(v.astype(up)), None, *extra)


def value(x) -> Value:
    if x.rank < 0:
        return matrix(x.a, x.kind, int(x.cols))
    k = int(x.rank)
    kind = np.complex128 if x.kind == "Z" else np.float64
    return np.frombuffer(x.a, kind).reshape(int(x.rows), k), np.frombuffer(x.b, kind).reshape(int(x.cols), k)


def dense_value(x) -> np.ndarray:
    v = value(x)
    return v[0] @ v[1].T if isinstance(v, tuple) else v


def over(x: np.ndarray, d: np.ndarray) -> np.ndarray:
    """D^-1 X, rows of null pivots 0."""
    zero = d == 0
    return np.where(zero[:, None], 0, x / np.where(zero, 1, d)[:, None])


def product(a: Value, b: Value) -> Value:
    """A B, low rank if one of them is."""
    if isinstance(a, tuple):
        return (a[0], (a[1].T @ b).T) if not isinstance(b, tuple) else (a[0] @ (a[1].T @ b[0]), b[1]) if b[0].shape[1] <= a[0].shape[1] else (a[0], b[1] @ (a[1].T @ b[0]).T)
    return (a @ b[0], b[1]) if isinstance(b, tuple) else a @ b


def turned(a: Value) -> Value:
    return (a[1], a[0]) if isinstance(a, tuple) else a.T


def total(parts: Iterable[Value], shape: tuple[int, int], eps: float) -> Value:
    """Sum of values: low rank while that is smaller than dense."""
    full, low = None, []
    for p in parts:
        if isinstance(p, tuple):
            low.append((1, p))
            if sum(x[1][0].shape[1] for x in low) > max(16, min(shape) // 2):
                low = [(1, lowrank.add(low, eps))]
        else:
            full = p.copy() if full is None else full + p
    if not low:
        return lowrank.zero_rk(*shape) if full is None else full
    one = lowrank.add(low, eps)
    if full is not None:
        return full + one[0] @ one[1].T
    return one if one[0].shape[1] * sum(shape) < shape[0] * shape[1] else one[0] @ one[1].T


def covers(nodes: DataFrame, strips: DataFrame) -> DataFrame:
    """(path, list): the strips (num, off, n) that a cluster meets: those inside it, or the one it is inside."""
    own = strips.select("strip", F.struct("num", "off", "n").alias("s"))
    above = own.select(F.explode(F.slice(prefixes("strip"), F.lit(1), F.length("strip") - 1)).alias("path"), "s")
    below = nodes.select("path", F.explode(prefixes("path")).alias("strip")).join(own, "strip").select("path", "s")
    return above.unionByName(below).groupBy("path").agg(F.sort_array(F.collect_list("s")).alias("list"))


def numbered(nodes: DataFrame, points: int) -> DataFrame:
    """Strips with their place in the order (one row each on the driver)."""
    rows = strips_of(nodes, points).orderBy("off").collect()
    return nodes.sparkSession.createDataFrame([(r["strip"], r["off"], r["n"], k) for k, r in enumerate(rows)], "strip string, off long, n long, num int")


def tiles_of(m, strips: DataFrame, lower: bool, eps: float) -> tuple[DataFrame, str]:
    """The leaves of a matrix cut to tiles and put together again: ``TILE``, and the kind of numbers.  ``lower``: tiles on and below the diagonal, mirrored inside those on it."""
    from .matrix import payload

    kind = "Z" if (m.leaves.agg(F.max(F.col("dtype").isin("C", "Z", "Q"))).first()[0] or False) else "D"
    cover = settle(covers(m.row_nodes, strips))
    leaves = m.leaves.select("r", "c", "r_off", "r_n", "c_off", "c_n", "kind", "rank", "dtype", "a", "b", "d")
    if lower:
        leaves = leaves.where("r_off >= c_off")
    side = lambda s: cover.select(F.col("path").alias(s), F.col("list").alias(f"{s}_list"))
    met = leaves.join(side("r"), "r").join(side("c"), "c")

    def pieces(x):
        v = payload(x)
        for p in x.r_list:
            r0, r1 = max(p["off"], x.r_off), min(p["off"] + p["n"], x.r_off + x.r_n)
            for q in x.c_list:
                if lower and p["num"] < q["num"]:
                    continue
                c0, c1 = max(q["off"], x.c_off), min(q["off"] + q["n"], x.c_off + x.c_n)
                i, j = slice(r0 - x.r_off, r1 - x.r_off), slice(c0 - x.c_off, c1 - x.c_off)
                part = (v[0][i], v[1][j]) if isinstance(v, tuple) else v[i, j]
                yield (*tile(p["num"], q["num"], part, kind), r0 - p["off"], c0 - q["off"], p["n"], q["n"])

    cut_ = each_row(met, pieces, TILE + ", r_at int, c_at int, t_rows int, t_cols int")

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.iloc[0]
        shape = int(first["t_rows"]), int(first["t_cols"])
        on_diagonal = first["i"] == first["j"]
        full, low = None, []
        for x in frame.itertuples():
            v = value(x)
            r, c = slice(x.r_at, x.r_at + x.rows), slice(x.c_at, x.c_at + x.cols)
            if isinstance(v, tuple) and not on_diagonal:
                if v[0].shape[1] == 0:
                    continue
                a, b = np.zeros((shape[0], v[0].shape[1]), v[0].dtype), np.zeros((shape[1], v[0].shape[1]), v[0].dtype)
                a[r], b[c] = v
                low.append(v if a.shape == v[0].shape and b.shape == v[1].shape else (a, b))
            else:
                full = np.zeros(shape, complex if kind == "Z" else float) if full is None else full
                v = v[0] @ v[1].T if isinstance(v, tuple) else v
                full[r, c] += v
                if lower and on_diagonal and x.r_at != x.c_at:
                    full[c, r] += v.T
        v = total([*([full] if full is not None else []), *low], shape, eps if len(low) > 1 else -1)
        return pd.DataFrame([tile(int(first["i"]), int(first["j"]), v, kind)], columns=_NAMES)

    return settle(cut_.groupBy("i", "j").applyInPandas(joined, TILE)), kind


def gathered(tables: list[DataFrame]) -> DataFrame:
    """Settled tables of one schema as one scan."""
    first = tables[0]
    return first.sparkSession.read.schema(first.schema).parquet(*[t._settled_at for t in tables])


def _reduced(parts: DataFrame, eps: float, many: int, fan: int = 16) -> DataFrame:
    """Sums of tiles of one place: in groups of ``fan`` by ``part``, round by round."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        x = frame.iloc[0]
        v = total((value(r) for r in frame.itertuples()), (int(x["rows"]), int(x["cols"])), eps)
        return pd.DataFrame([(*tile(int(x["i"]), int(x["j"]), v, x["kind"]), int(x["part"]) // fan)], columns=[*_NAMES, "part"])

    while True:
        parts = parts.withColumn("_p", F.expr(f"part div {fan}")).groupBy("i", "j", "_p").applyInPandas(add, TILE + ", part int")
        many = -(-many // fan)
        if many <= 1:
            return parts.drop("part")


def factor(m, kind: str, eps: float, strip_points: int, null_pivots: float = 0.0) -> dict[str, DataFrame]:
    """Tables: places, strips, diagonal (factored tiles), low (tiles below) and, for lu, up (tiles above).

    Pivots of at most ``null_pivots`` times the matrix's largest diagonal entry are skipped.
    """
    strips = numbered(m.row_nodes, strip_points)
    count = strips.count()
    a, scalar = tiles_of(m, strips, kind != "lu", eps)
    least = 0.0
    if null_pivots:
        largest = each_row(a.where("i = j"), lambda x: [(float(np.abs(np.diag(dense_value(x))).max(initial=0)),)], "v double").agg(F.max("v")).first()[0]
        least = null_pivots * (largest or 0.0)
    below, above, middle = [], [], []

    def times(x):
        left = value(x)
        right = value(_Other(x))
        if kind == "ldlt":
            d = np.frombuffer(x.d, complex if scalar == "Z" else float)
            left = (left[0], left[1] * d[:, None]) if isinstance(left, tuple) else left * d
        v = product(left, right if kind == "lu" else turned(right))
        v = (-v[0], v[1]) if isinstance(v, tuple) else -v
        yield (*tile(x.i, int(x.to), v, scalar), int(x.j) + 1)

    def eliminated(k: int, which: DataFrame, left: list[DataFrame], right: list[DataFrame], rows: str, cols: str) -> DataFrame:
        """Tiles of A at ``which`` minus the products of those finished before."""
        base = a.where(which).withColumn("part", F.lit(0))
        if k == 0:
            return settle(base.drop("part"))
        l, r = gathered(left).where(rows), gathered(right)  # noqa: E741
        if kind == "lu":
            r = r.where(cols).select(F.col("i").alias("j"), F.col("j").alias("to"), *[F.col(n).alias(f"o_{n}") for n in _NAMES[2:]])
        else:
            r = r.where(cols).select("j", F.col("i").alias("to"), *[F.col(n).alias(f"o_{n}") for n in _NAMES[2:]])
        pairs = l.join(r, "j")
        if kind == "ldlt":
            pairs = pairs.join(gathered(middle).select("j", F.col("diag").alias("d")), "j")
        return settle(_reduced(base.unionByName(each_row(pairs, times, TILE + ", part int")), eps, k + 1))

    def diagonal(x):
        v = dense_value(x)
        if kind == "lu":
            low, order = dense.lu(v, least)
            yield tile(x.i, x.j, low, scalar, order)
        elif kind == "llt":
            yield tile(x.i, x.j, dense.llt(v, least), scalar)
        else:
            low, d = dense.ldlt(v, least)
            yield tile(x.i, x.j, low, scalar, None, d)

    def solved(x):
        v, d = value(x), value(_Other(x))
        if x.i < x.j:  # right of the diagonal: L^-1 P A
            order = np.frombuffer(x.o_order, np.int64)
            yield tile(x.i, x.j, (dense.lower_solve(d, v[0][order], True), v[1]) if isinstance(v, tuple) else dense.lower_solve(d, v[order], True), scalar)
            return
        if kind == "lu":
            change = lambda p: dense.lower_solve(d.T, p)  # noqa: E731  (A U^-1)^T = U^-T A^T
        elif kind == "llt":
            change = lambda p: dense.lower_solve(d, p)
        else:
            s = np.frombuffer(x.o_diag, complex if scalar == "Z" else float)
            change = lambda p: over(dense.lower_solve(d, p, True), s)
        yield tile(x.i, x.j, (v[0], change(v[1])) if isinstance(v, tuple) else change(v.T).T, scalar)

    for k in range(count):
        column = eliminated(k, F.expr(f"j = {k} and i >= {k}"), below, above if kind == "lu" else below, f"i >= {k}", f"j = {k}" if kind == "lu" else f"i = {k}")
        done = settle(each_row(column.where(f"i = {k}"), diagonal, TILE))
        middle.append(done)
        if k + 1 == count:
            if not below:
                below, above = [settle(a.limit(0))], [settle(a.limit(0))]
            break
        with_ = done.select(*[F.col(n).alias(f"o_{n}") for n in _NAMES[2:]])
        rest = column.where(f"i > {k} and rank <> 0")
        below.append(settle(each_row(rest.crossJoin(F.broadcast(with_)), solved, TILE)))  # one tile
        if kind == "lu":
            row = eliminated(k, F.expr(f"i = {k} and j > {k}"), below, above, f"i = {k} and j < {k}", f"j > {k}")
            above.append(settle(each_row(row.where("rank <> 0").crossJoin(F.broadcast(with_)), solved, TILE)))
    out = {"places": settle(places_of(m.row_perm, strips)), "strips": settle(strips), "diagonal": gathered(middle), "low": gathered(below)}
    return out | ({"up": gathered(above)} if kind == "lu" else {})


class _Other:
    """The second tile of a joined row."""

    def __init__(self, x):
        self.rank, self.kind, self.rows, self.cols, self.a, self.b = x.o_rank, x.o_kind, x.o_rows, x.o_cols, x.o_a, x.o_b


_X = "num int, g int, n int, k int, x binary"


def _numbers(tables: dict[str, DataFrame]) -> str:
    first = tables["diagonal"].select("kind").first()
    return first["kind"] if first else "D"


def triangular(tables: dict[str, DataFrame], x: DataFrame, scalar: str, uplo: str, trans: str, unit: bool) -> DataFrame:
    """op(T)^-1 X for X given as (num, g, n, k, x): pieces of n x k numbers of ``scalar`` by strip and group of columns; missing pieces are 0.

    A strip waits for those that its tiles lead to; all strips of a wave wait for earlier waves only and are solved at once.
    The driver holds the places of the tiles (at most 4,000,000), no number of them.
    """
    tiles = tables["low" if uplo == "L" else "up"]
    pairs = [(r["i"], r["j"]) if trans == "N" else (r["j"], r["i"]) for r in tiles.select("i", "j").limit(_MOST_TILES + 1).collect()]
    if len(pairs) > _MOST_TILES:
        raise ValueError(f"more than {_MOST_TILES} tiles")
    waits: dict[int, list[int]] = {}
    for to, of in pairs:
        waits.setdefault(to, []).append(of)
    order = sorted(r["num"] for r in tables["strips"].select("num").collect())
    forward = (uplo == "L") == (trans == "N")
    wave: dict[int, int] = {}
    for s in order if forward else reversed(order):
        wave[s] = 1 + max((wave[o] for o in waits.get(s, ())), default=-1)
    turn = trans != "N"
    edges = tiles.select(F.col("j" if turn else "i").alias("to"), F.col("i" if turn else "j").alias("num"), *_NAMES[2:])
    conj = trans == "C"

    def pushed(e):
        v = value(e)
        v = turned(v) if turn else v
        if conj:
            v = tuple(p.conj() for p in v) if isinstance(v, tuple) else v.conj()
        b = matrix(e.x, scalar, int(e.k))
        y = -(v[0] @ (v[1].T @ b) if isinstance(v, tuple) else v @ b)
        yield e.to, e.g, len(y), e.k, blob(y)

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.iloc[0]
        y = sum(matrix(b, scalar, int(first["k"])) for b in frame["x"])
        return pd.DataFrame([(first["num"], first["g"], first["n"], first["k"], blob(y))], columns=["num", "g", "n", "k", "x"])

    def solved(e):
        low, b = matrix(e.a, e.kind, int(e.cols)), matrix(e.x, scalar, int(e.k))
        low = low.conj() if conj else low
        swap = None if e.order is None or uplo == "U" else np.frombuffer(e.order, np.int64)
        if swap is not None and not turn:
            b = b[swap]
        y = dense.trsm(low, b, uplo=uplo, trans="T" if turn else "N", unit=unit)
        if swap is not None and turn:
            y[swap] = y.copy()
        yield e.num, e.g, e.n, e.k, blob(y)

    done: list[DataFrame] = []
    for w in range(max(wave.values(), default=-1) + 1):
        mine = [s for s, v in wave.items() if v == w]
        pieces = x.where(F.col("num").isin(mine))
        if done:
            ready = edges.where(F.col("to").isin(mine)).join(gathered(done).select("num", "g", "k", "x"), "num")
            more = each_row(ready, pushed, _X)
            pieces = pieces.unionByName(more).groupBy("num", "g").applyInPandas(added, _X)
        done.append(settle(each_row(pieces.join(tables["diagonal"].select(F.col("i").alias("num"), "rows", "cols", "kind", "a", "order"), "num"), solved, _X)))
    return gathered(done) if done else x


def _scaled(tables: dict[str, DataFrame], x: DataFrame, scalar: str, inverse: bool) -> DataFrame:
    """D X or D^-1 X of an LDLt factor."""

    def run(e):
        d = np.frombuffer(e.diag, complex if e.kind == "Z" else float)[:, None]
        b = matrix(e.x, scalar, int(e.k))
        yield e.num, e.g, e.n, e.k, blob(over(b, d[:, 0]) if inverse else b * d)

    return settle(each_row(x.join(tables["diagonal"].select(F.col("i").alias("num"), "kind", "diag"), "num"), run, _X))


def _times(tables: dict[str, DataFrame], x: DataFrame, scalar: str, uplo: str, trans: str, unit: bool) -> DataFrame:
    """op(T) X: every tile with its piece at once, sums by strip."""
    turn = trans == "T"
    to, of = ("j", "i") if turn else ("i", "j")
    off = tables["low" if uplo == "L" else "up"]
    every = off.unionByName(tables["diagonal"])

    def run(e):
        v, b = value(e), matrix(e.x, scalar, int(e.k))
        if e.to != e.num:
            v = turned(v) if turn else v
            y = v[0] @ (v[1].T @ b) if isinstance(v, tuple) else v @ b
        else:
            t = np.tril(v) if uplo == "L" else np.triu(v)
            if unit:
                np.fill_diagonal(t, 1)
            y = (t.T if turn else t) @ b
            if e.order is not None and uplo == "L" and not turn:
                y[np.frombuffer(e.order, np.int64)] = y.copy()
        yield e.to, e.g, len(y), e.k, blob(y)

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.iloc[0]
        return pd.DataFrame([(first["num"], first["g"], first["n"], first["k"], blob(sum(matrix(b, scalar, int(first["k"])) for b in frame["x"])))], columns=["num", "g", "n", "k", "x"])

    edges = every.select(F.col(to).alias("to"), F.col(of).alias("num"), *_NAMES[2:])
    met = edges.join(x.select("num", "g", "k", "x"), "num")
    return settle(each_row(met, run, _X).groupBy("num", "g").applyInPandas(added, _X))


def solve(tables: dict[str, DataFrame], kind: str, x: DataFrame, scalar: str, part: str = "both", op: str = "N") -> DataFrame:
    """op(A)^-1 X through the factor, or with its lower or upper part alone (L and L^T of the symmetric kinds)."""
    unit = kind != "llt"
    if kind == "lu":
        steps = {"lower": ("L", True), "upper": ("U", False)}
        names = [p for p in (("lower", "upper") if op == "N" else ("upper", "lower")) if part in ("both", p)]
        for p in names:
            x = triangular(tables, x, scalar, steps[p][0], op, steps[p][1])
        return x
    # symmetric: A = A^T, and the transpose of a part is the other part
    first = part in ("both", "lower" if op == "N" else "upper")
    last = part in ("both", "upper" if op == "N" else "lower")
    if first:
        x = triangular(tables, x, scalar, "L", "N", unit)
    if part == "both" and kind == "ldlt":
        x = _scaled(tables, x, scalar, True)
    return triangular(tables, x, scalar, "L", "T", unit) if last else x


def times(tables: dict[str, DataFrame], kind: str, x: DataFrame, scalar: str) -> DataFrame:
    if kind == "lu":
        return _times(tables, _times(tables, x, scalar, "U", "N", False), scalar, "L", "N", True)
    x = _times(tables, x, scalar, "L", "T", kind == "ldlt")
    x = _scaled(tables, x, scalar, False) if kind == "ldlt" else x
    return _times(tables, x, scalar, "L", "N", kind == "ldlt")


def of_vectors(tables: dict[str, DataFrame], x: DataFrame, change) -> DataFrame:
    """``change(pieces, kind of numbers) -> pieces`` on vectors in the users' numbering."""
    v = Vectors(x, tables["places"], tables["strips"], _numbers(tables))
    if not v.ids:
        return v.rows(v.table)
    k = len(v.ids)
    pieces = v.table.join(tables["strips"].select("strip", "num"), "strip").select("num", F.lit(0).alias("g"), F.col("n").cast("int").alias("n"), F.lit(k).alias("k"), "x")
    return v.rows(change(settle(pieces), v.kind).join(tables["strips"].select("strip", "num"), "num"))


def log_determinant(tables: dict[str, DataFrame], kind: str) -> DataFrame:
    def run(e):
        d = np.frombuffer(e.diag, complex if e.kind == "Z" else float) if kind == "ldlt" else np.diag(matrix(e.a, e.kind, int(e.cols)))
        yield (float(np.log(np.abs(d)).sum()),)

    half = each_row(tables["diagonal"], run, "s double").agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"))
    whole = F.col("s") * (2 if kind == "llt" else 1)
    return half.select(whole.alias("logdet"), (whole if kind == "lu" else whole / 2).alias("factor_logdet"))


def inverse_parts(tables: dict[str, DataFrame], kind: str) -> DataFrame:
    """Dense blocks of A^-1, one for each pair of strips."""
    scalar = _numbers(tables)

    def unit(e):
        yield e.num, e.num, e.n, e.n, blob(np.eye(int(e.n), dtype=complex if scalar == "Z" else float))

    x = solve(tables, kind, settle(each_row(tables["strips"].select("num", "n"), unit, _X)), scalar)
    rows = tables["strips"].select("num", F.col("off").alias("r_off"))
    cols = tables["strips"].select(F.col("num").alias("g"), F.col("off").alias("c_off"))
    met = x.join(rows, "num").join(cols, "g")
    return met.select(F.concat_ws(":", "num", "g").alias("id"), "r_off", F.col("n").cast("long").alias("r_n"), "c_off", F.col("k").cast("long").alias("c_n"), F.lit(-1).alias("rank"), F.lit(scalar).alias("kind"), F.col("x").alias("a"), F.lit(None).cast("binary").alias("b"))
