"""Kept factors, triangular solves and whole-matrix operations against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockwood.functions import dense, lowrank
from blockwood.functions.kernels import Kernel
from blockwood.operators.blocks import Admissibility
from blockwood.operators.cluster import Clustering
from blockwood.operators.factor import Factor
from blockwood.operators import strips, tiles, wide
from blockwood.operators.matrix import HMatrix
from blockwood.sources import points as P

N = 60


@pytest.fixture(scope="module")
def line(spark):
    return P.points(spark.range(N).selectExpr("id", "double(id * id % 61) AS x", "double(id % 5) AS y"), "id", ["x", "y"])


def build(cloud, **more):
    given = {"clustering": Clustering(max_leaf=8), "admissibility": Admissibility("hodlr"), "eps": 1e-13} | more
    return HMatrix.build(cloud, Kernel("exp", 6.0, nugget=0.5), **given)


def whole(m):
    out = np.zeros((N, N))
    for r in m.values().collect():
        out[r.row_dof, r.col_dof] = r.re
    return out


def vectors(spark, x):
    return spark.createDataFrame([(i, k, float(x[i, k])) for i in range(len(x)) for k in range(x.shape[1])], "dof long, rhs int, re double")


def array(df, k=2):
    out = np.zeros((N, k))
    for r in df.collect():
        out[r.dof, r.rhs] = r.re
    return out


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(0).normal(size=(N, 2))


@pytest.mark.parametrize(("kind", "points"), [("lu", None), ("lu", 16), ("llt", 16), ("ldlt", 16), ("hodlr", 16), ("hodlrsym", 16)])
def test_one_factor_solves_again_after_it_was_saved(spark, line, x, tmp_path, kind, points):
    """In one strip, and in four to eight strips or tiles."""
    m = build(line, symmetric=kind != "lu")
    a = whole(m)
    f = m.factorize(kind, strip_points=points)
    assert (f.tables["strips"].count() > 3) == (points is not None)
    f.save(str(tmp_path / "f"))
    assert np.allclose(a @ array(f.solve(vectors(spark, x))), x, atol=1e-8)
    g = Factor.load(spark, str(tmp_path / "f"))
    assert np.allclose(a @ array(g.solve(vectors(spark, x), op="T")), x, atol=1e-8) if kind != "lu" else np.allclose(a.T @ array(g.solve(vectors(spark, x), op="T")), x, atol=1e-8)
    assert g.log_determinant().first().logdet == pytest.approx(np.linalg.slogdet(a)[1])
    if kind != "hodlr":
        assert np.allclose(array(g.times(vectors(spark, x))), a @ x, atol=1e-8)
        halves = f.solve(f.solve(vectors(spark, x), "lower").select("dof", "rhs", "re"), "upper")
        assert np.allclose(a @ array(halves), x, atol=1e-8) or kind == "ldlt"


def test_blocks_of_a_standard_matrix_in_tiles(spark, line, x):
    """Leaves larger and smaller than a tile, and one vector that names few dofs."""
    m = build(line, symmetric=True, admissibility=Admissibility("standard"))
    a, f = whole(m), m.factorize("llt", strip_points=16)
    few = vectors(spark, x).where("dof in (3, 40) and rhs = 1")
    want = np.zeros((N, 2))
    want[[3, 40], 1] = x[[3, 40], 1]
    assert np.allclose(a @ array(f.solve(few)), want, atol=1e-8)
    low = array(f.solve(vectors(spark, np.eye(N)), "lower"), N)  # L^-1 in the users' numbering
    assert np.allclose(low.T @ low, np.linalg.inv(a), atol=1e-8)
    with pytest.raises(ValueError):
        m.factorize("hodlr", strip_points=16)


def test_complex_factor(spark):
    cloud = P.cylinder(spark, N)
    m = HMatrix.build(cloud, Kernel("helmholtz", wave=2.0, nugget=0.0), clustering=Clustering(max_leaf=8), admissibility=Admissibility("hodlr"), eps=1e-12, scalar="Z")
    b = spark.range(N).selectExpr("id AS dof", "0 AS rhs", "1.0 + id % 3 AS re", "0.5 * (id % 5) AS im")
    for kind in ("lu", "hodlr"):
        x = m.factorize(kind, strip_points=20).solve(b)
        rest = {r.dof: complex(r.re, r.im) for r in m.gemv(x).collect()}
        assert all(abs(rest[i] - complex(1 + i % 3, 0.5 * (i % 5))) < 1e-6 for i in range(N))


def test_trsm_in_all_cases(spark, line):
    """Against the inverses of both parts, which multiply to that of the matrix."""
    m = build(line).multiply_with_diagonal(vectors(spark, 1 + np.arange(N)[:, None] % 3.0).drop("rhs"))
    a, f, eye = whole(m), m.factorize("lu", strip_points=31), vectors(spark, np.eye(N))
    inv = {u: array(f.trsm(eye, uplo=u), N) for u in "LU"}
    assert np.allclose(inv["U"] @ inv["L"], np.linalg.inv(a), atol=1e-8)
    b = np.random.default_rng(1).normal(size=(N, 2))
    for uplo in "LU":
        for trans, op in (("N", inv[uplo]), ("T", inv[uplo].T), ("C", inv[uplo].T)):
            assert np.allclose(array(f.trsm(vectors(spark, b), uplo=uplo, trans=trans, alpha=2)), 2 * op @ b, atol=1e-8)
            assert np.allclose(array(f.trsm(vectors(spark, b), side="R", uplo=uplo, trans=trans)).T, b.T @ op, atol=1e-8)


def test_strips_do_without_order(spark):
    """QR of stacked strips in rounds of two, sums of arrays, and strips of a tree."""
    rng = np.random.default_rng(3)
    parts = [rng.normal(size=(n, 4)) for n in (3, 9, 1, 6, 5)]
    rows = [("p", k, "D", 4, np.linalg.qr(y, mode="r").tobytes()) for k, y in enumerate(parts)]
    r = strips.tree_qr(spark.createDataFrame(rows, "key string, num long, kind string, columns int, r binary"), ["key"], 5, fan=2).collect()
    y, found = np.concatenate(parts), strips.matrix(r[0].r, "D", 4)
    assert len(r) == 1 and np.allclose(found.T @ found, y.T @ y)
    b, t = strips.basis(found)
    assert np.allclose((y @ b).T @ (y @ b), np.eye(4)) and np.allclose(y @ b @ t, y)
    assert strips.basis(np.zeros((4, 4)))[0].shape == (4, 0)
    sums = strips.summed(spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", [5.0])], "key string, g array<double>"), ["key"]).collect()
    assert {s.key: s.g for s in sums} == {"a": [4.0, 6.0], "b": [5.0]}


def test_sums_of_tiles():
    rng = np.random.default_rng(4)
    low = [(rng.normal(size=(12, 2)), rng.normal(size=(9, 2))) for _ in range(9)]
    want = sum(a @ b.T for a, b in low)
    dense_of = lambda v: v[0] @ v[1].T if isinstance(v, tuple) else v
    assert np.allclose(dense_of(tiles.total(low, (12, 9), 1e-13)), want)
    assert np.allclose(dense_of(tiles.total([*low, np.ones((12, 9))], (12, 9), 1e-13)), want + 1)
    for p in (low[0], want):
        for q in (low[1], want):
            assert np.allclose(dense_of(tiles.product(p, tiles.turned(q))), dense_of(p) @ dense_of(q).T)


def test_lu_of_half_and_unknown_kinds_are_refused(line):
    m = build(line, symmetric=True)
    for kind in ("lu", "qr"):
        with pytest.raises(ValueError):
            m.factorize(kind)


def test_products_sums_and_parts(spark, line, x):
    m, s = build(line), build(line, admissibility=Admissibility("standard"), symmetric=True)
    a = whole(m)
    assert np.allclose(whole(m.multiply(s, 2.0, -1.0, m)), 2 * a @ a - a, atol=1e-8)
    assert np.allclose(whole(m.axpy(-3.0, s)), -2 * a, atol=1e-8)
    d = vectors(spark, x[:, :1]).drop("rhs")
    md = m.multiply_with_diagonal(d)
    assert np.allclose(whole(md), a * x[:, 0]) and np.allclose(whole(md.multiply_with_diagonal(d, "L", inverse=True)), a * x[:, 0] / x[:, :1])
    assert np.allclose(whole(md.transpose()), (a * x[:, 0]).T)
    assert np.allclose(array(md.gemv(vectors(spark, x), op="C")), (a * x[:, 0]).T @ x)
    assert np.allclose(whole(m.multiply(md, op=("T", "T"))), a.T @ (a * x[:, 0]).T, atol=1e-8)
    assert np.allclose(whole(m.inverse()) @ a, np.eye(N), atol=1e-7)
    assert np.allclose(whole(m.inverse(strip_points=31)) @ a, np.eye(N), atol=1e-7)
    assert np.allclose(whole(s.multiply(m, 2.0, -1.0, s)), 2 * a @ a - a, atol=1e-8)
    full = build(line, admissibility=Admissibility("never", max_block=400))
    assert np.allclose(whole(full.multiply(m, 1.0, 1.0, full)), a @ a + a, atol=1e-8)
    assert np.allclose(whole(m.multiply(full)), a @ a, atol=1e-8)
    other = build(line, clustering=Clustering("median", divider=3, max_leaf=5))
    if not m._order(other):  # other cuts of the same order
        assert np.allclose(whole(m.axpy(2.0, other)), 3 * a, atol=1e-8)
    assert np.allclose(whole(m.subtract_mdmt(m, d)), a - (a * x[:, 0]) @ a.T, atol=1e-8)
    ids = spark.createDataFrame([(3,), (59,), (7,), (99,)], "dof long")
    for h in (m, s):
        got = {(r.row_dof, r.col_dof): r.re for r in h.get_values(ids, ids.where("dof <> 7")).collect()}
        assert got == {(i, j): pytest.approx(a[i, j], abs=1e-9) for i in (3, 59, 7) for j in (3, 59)}
    with pytest.raises(ValueError):
        m.child(5, 0)
    part = m.subset(5, 20, 31, 9)
    order = [r.dof for r in m.row_perm.orderBy("pos").collect()]
    cut = a[np.ix_(order, order)][5:25, 31:40]
    out = np.zeros((20, 9))
    for r in HMatrix(m.row_nodes, m.row_perm, m.col_nodes, m.col_perm, m.blocks, part).entries().collect():
        out[r.row_pos - 5, r.col_pos - 31] = r.re
    assert np.allclose(out, cut, atol=1e-9)


def test_numbering_must_agree_and_compression_is_validated(spark, line):
    m = build(line)
    other = build(line.withColumn("coord", F.transform("coord", lambda v: -v)).withColumns({"lo": F.col("coord"), "hi": F.col("coord")}))
    with pytest.raises(ValueError):
        m.axpy(1.0, other)
    assert m.validated(Kernel("exp", 6.0, nugget=0.5)).where("error > 1e-9 * norm").count() == 0
    noisy = m.perturbed(0.1)
    assert noisy.validated(Kernel("exp", 6.0, nugget=0.5)).where("error > 1e-3 * norm").count() > 0
    assert m.copy_structure().checks().first().all_zero


@pytest.mark.parametrize("method", lowrank.METHODS)
def test_compressors_find_ranks_above_one(method):
    rng = np.random.default_rng(5)
    for rank in (0, 1, 3, 7):
        m = rng.normal(size=(40, rank)) @ rng.normal(size=(rank, 30)) if rank else np.zeros((40, 30))
        a, b = lowrank.compress(m, method, 1e-10)
        assert np.allclose(a @ b.T, m, atol=1e-8) and rank <= a.shape[1] <= rank + 2
    block = np.zeros((20, 20))
    block[13:, 4:9] = rng.normal(size=(7, 1)) @ rng.normal(size=(1, 5))
    a, b = lowrank.compress(block, method, 1e-10)
    assert np.allclose(a @ b.T, block, atol=1e-8) or method == "aca_random"
    assert dense.rank_by(np.linalg.svd(block)[1], 1e-10) == 1


def test_blocks_beyond_a_task(spark):
    """Every low-rank block of more than 50 points is compressed in strips of 25: as good as in one task; panels are truncated by a tree of QRs."""
    n = 120
    cloud = P.points(spark.range(n).selectExpr("id", "double(id * id % 121) AS x", "double(id % 7) AS y"), "id", ["x", "y"])
    kernel = Kernel("exp", 6.0, nugget=0.5)
    m = HMatrix.build(cloud, kernel, clustering=Clustering(max_leaf=30), admissibility=Admissibility("hodlr"), eps=1e-9, task_points=50)
    worst = m.validated(kernel).agg(F.max(F.col("error") / F.col("norm")), F.max("rank"), F.count(F.lit(1))).first()
    assert worst[0] < 1e-7 and worst[1] <= 25 and worst[2] == 6
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(50, 9)) * 10.0 ** -np.arange(9), rng.normal(size=(31, 9))
    rows = [("p", side, k, 7 * k, len(part), 9, "D", part.tobytes()) for side, x in ((0, a), (1, b)) for k, part in enumerate(np.split(x, range(7, len(x), 7)))]
    cut = wide.truncated(spark.createDataFrame(rows, wide.PANEL), 1e-5).collect()
    panels = [np.concatenate([np.frombuffer(r.panel).reshape(r.n, r["rank"]) for r in sorted(cut, key=lambda r: r.num) if r.side == side]) for side in (0, 1)]
    one = lowrank.truncate((a, b), 1e-5)
    assert panels[0].shape == one[0].shape and panels[1].shape == one[1].shape and np.allclose(panels[0] @ panels[1].T, one[0] @ one[1].T, atol=1e-12)


@pytest.mark.parametrize("kind", ["lu", "llt", "ldlt", "hodlr", "hodlrsym"])
def test_factors_over_points_that_occur_three_times(spark, kind):
    """The matrix is singular: null pivots are skipped, b = A v still has a solution, and the factors still multiply to A."""
    cloud = P.points(spark.range(N).selectExpr("id", "double((id % 20) * (id % 20) * (id % 20) % 23) AS x"), "id", ["x"])
    m = HMatrix.build(cloud, Kernel("exp", 6.0), clustering=Clustering(max_leaf=8), admissibility=Admissibility("hodlr"), eps=1e-13, symmetric=kind != "lu")
    a, v = whole(m), np.random.default_rng(1).normal(size=(N, 2))
    assert np.linalg.matrix_rank(a) == 20 < N
    f = m.factorize(kind, strip_points=16, null_pivots=1e-8)
    b = a @ v
    assert np.allclose(a @ array(f.solve(vectors(spark, b))), b, atol=1e-8)
    if kind != "hodlr":
        assert np.allclose(array(f.times(vectors(spark, v))), b, atol=1e-8)


def test_null_pivots_of_dense_blocks():
    g = np.random.default_rng(2).normal(size=(6, 3))
    s = g @ g.T
    low, d = dense.ldlt(s, 1e-10)
    assert (d == 0).sum() == 3 and np.allclose(low * d @ low.T, s)
    assert np.allclose(dense.llt(s, 1e-10) @ dense.llt(s, 1e-10).T, s)
    lu, order = dense.lu(s, 1e-10)
    assert np.allclose(s[order], (np.tril(lu, -1) + np.eye(6)) @ np.triu(lu))
    assert np.allclose(s @ dense.lu_solve((lu, order), s), s)
    inverse, order, log = dense.lu_or_pinv(s, 1e-10)
    assert log == -np.inf and np.allclose(s @ dense.lu_solve((inverse, order), s), s)
    with pytest.raises(ZeroDivisionError):  # not semidefinite: nothing can be skipped
        dense.ldlt(np.array([[0.0, 1.0], [1.0, 0.0]]), 1e-10)
