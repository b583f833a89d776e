"""Dense and low-rank kernels, and packed leaves."""

from dataclasses import replace

import numpy as np
import pytest

from blockwood.functions import bits, dense, lowrank
from blockwood.functions.kernels import Kernel
from blockwood.operators.blocks import Admissibility
from blockwood.operators.cluster import Clustering
from blockwood.operators.matrix import HMatrix
from blockwood.sources import points as P

RNG = np.random.default_rng(1)


def smooth(n=40, m=30, kind=float):
    x, y = np.linspace(0, 1, n), np.linspace(3, 5, m)
    r = np.abs(x[:, None] - y)
    return np.exp(1j * r) / r if kind is complex else 1 / r


@pytest.mark.parametrize("method", lowrank.METHODS)
@pytest.mark.parametrize("kind", [float, complex])
def test_compression_keeps_its_error_bound(method, kind):
    m = smooth(kind=kind)
    for eps in (1e-3, 1e-8):
        a, b = lowrank.compress(m, method, eps)
        assert np.linalg.norm(m - a @ b.T) <= 20 * eps * np.linalg.norm(m)
        assert a.shape[1] < 20


@pytest.mark.parametrize("method", lowrank.METHODS)
def test_exact_rank_and_zero_blocks(method):
    m = np.outer(RNG.normal(size=9), RNG.normal(size=7))
    assert lowrank.compress(m, method, 1e-9)[0].shape[1] == 1
    assert lowrank.compress(0 * m, method, 1e-9)[0].shape[1] == 0
    assert lowrank.compress(np.zeros((0, 3)), method, 1e-9)[1].shape == (3, 0)


def test_truncation_and_sum():
    x = (RNG.normal(size=(20, 6)), RNG.normal(size=(15, 6)))
    y = lowrank.add([(1, x), (-1, x)], 1e-10)
    assert np.linalg.norm(y[0] @ y[1].T) < 1e-9 * np.linalg.norm(x[0] @ x[1].T) * 100
    for cut in (lowrank.truncate, lowrank.truncate_mgs):
        a, b = cut((np.hstack([x[0], x[0]]), np.hstack([x[1], x[1]])), 1e-9)
        assert a.shape[1] == 6 and np.allclose(a @ b.T, 2 * x[0] @ x[1].T)
    assert lowrank.norm_squared(x) == pytest.approx(np.linalg.norm(x[0] @ x[1].T) ** 2)


@pytest.mark.parametrize("side", "LR")
@pytest.mark.parametrize("uplo", "LU")
@pytest.mark.parametrize("trans", "NTC")
def test_trsm(side, uplo, trans):
    t = RNG.normal(size=(6, 6)) + 1j * RNG.normal(size=(6, 6)) + 5 * np.eye(6)
    tri = np.tril(t) if uplo == "L" else np.triu(t)
    b = RNG.normal(size=(6, 4)) if side == "L" else RNG.normal(size=(4, 6))
    op = {"N": tri, "T": tri.T, "C": tri.conj().T}[trans]
    x = dense.trsm(t, b, side=side, uplo=uplo, trans=trans, alpha=2)
    assert np.allclose(op @ x if side == "L" else x @ op, 2 * b)


def test_factorizations():
    a = RNG.normal(size=(8, 8))
    lu, order = dense.lu(a)
    assert np.allclose(a[order], (np.tril(lu, -1) + np.eye(8)) @ np.triu(lu))
    s = a + a.T + 20 * np.eye(8)
    low, d = dense.ldlt(s)
    assert np.allclose(low * d @ low.T, s)
    z = s + 1j * np.diag(RNG.normal(size=8))
    assert np.allclose(dense.llt(z) @ dense.llt(z).T, z)
    with pytest.raises(ZeroDivisionError):
        dense.ldlt(np.zeros((2, 2)))
    with pytest.raises(ZeroDivisionError):
        dense.lu(np.zeros((2, 2)))


def test_packed_columns():
    """Every number within half a step; small columns take few bits; nothing is lost with steps of one."""
    rng = np.random.default_rng(0)
    m = rng.normal(size=(37, 5)) * [1e6, 1, 1e-6, 0, 1]
    steps = np.array([1.0, 0.01, 1e-6, 0.0, 1e-9])
    data = bits.pack(m, steps)
    assert (np.abs(bits.unpack(data) - m) <= steps / 2 * (1 + 1e-9)).all() and len(data) < m.nbytes
    whole = rng.integers(-(2**40), 2**40, (9, 3)).astype(float)
    assert (bits.unpack(bits.pack(whole, np.ones(3))) == whole).all()
    for shape in ((0, 3), (4, 0), (1, 1)):
        assert bits.unpack(bits.pack(np.zeros(shape), np.ones(shape[1]))).shape == shape
    for kind in (1, 1j):
        a, b = rng.normal(size=(60, 6)) * 10.0 ** -np.arange(6) + kind * rng.normal(size=(60, 6)) * 10.0 ** -np.arange(6), rng.normal(size=(45, 6))
        exact = a @ b.T
        for eps in (1e-2, 1e-6):
            x, y = (bits.numbers(p, np.iscomplexobj(a)) for p in bits.panels((a, b.astype(a.dtype)), eps))
            assert np.linalg.norm(x @ y.T - exact) <= eps * np.linalg.norm(exact, 2) * 1.01
            assert np.linalg.norm(bits.numbers(bits.block(exact, eps), np.iscomplexobj(a)) - exact) <= eps * np.linalg.norm(exact)


@pytest.mark.parametrize("scalar", ["D", "Z"])
def test_packed_leaves(spark, scalar):
    cloud = P.cylinder(spark, 90)
    kernel = Kernel("exp", 1.0) if scalar == "D" else Kernel("helmholtz", wave=2.0)
    m = HMatrix.build(cloud, kernel, clustering=Clustering(max_leaf=15), eps=1e-9, scalar=scalar)
    q, ratio = m.quantise(1e-5)
    sizes = {r.kind: (r.raw, r.stored) for r in ratio.collect()}
    bytes_of = lambda h: h.checks().first().bytes
    assert sum(s for _, s in sizes.values()) == bytes_of(q) and sum(r for r, _ in sizes.values()) == bytes_of(m) and 2 * bytes_of(q) < bytes_of(m)
    entries = lambda h: {(r.row_pos, r.col_pos): complex(r.re, r.im) for r in h.entries().collect()}
    a, b = entries(m), entries(q)
    assert sum(abs(a[k] - b[k]) ** 2 for k in a) ** 0.5 <= 1e-5 * m.norm()
    assert entries(q.scale(2.0)) == {k: pytest.approx(2 * v) for k, v in b.items()} and entries(q.transpose()) == {(j, i): pytest.approx(v) for (i, j), v in b.items()}


@pytest.mark.parametrize("copies", [1, 2, 6])
@pytest.mark.parametrize("terms", [1, 2])
def test_rounding_has_no_rank(copies, terms):
    """Off the diagonal one exponential on a line has rank 1 and two have rank 2, also by aca_plus, where a block's entries are far apart in size."""
    rng = np.random.default_rng(2)
    at = np.sort(np.tile(rng.uniform(-999, 9999, 1000).round(2), copies))[:, None]
    length = 0.1 * float(np.ptp(at))
    k = Kernel("exp", length, strata=()) if terms == 1 else Kernel("user", user=lambda p, q, i, j: np.exp(-np.abs(p - q.T) / length) + 0.5 * np.exp(-np.abs(p - q.T) / (2 * length)))
    todo, ranks = [(0, len(at))], set()
    while todo:
        off, n = todo.pop()
        if n > 12:
            a, b = np.arange(off, off + n // 2), np.arange(off + n // 2, off + n)
            ranks |= {k.panels(at[i], at[j], i, j, "aca_plus", 1e-9, 0)[0].shape[1] for i, j in ((a, b), (b, a))}
            todo += [(off, n // 2), (off + n // 2, n - n // 2)]
    assert ranks == {terms}


@pytest.mark.parametrize("method", lowrank.METHODS)
def test_points_that_occur_more_than_once_are_taken_once(monkeypatch, method):
    """Copies, of different numbers, cost no entries, and change neither rank nor precision."""
    from blockwood.functions import kernels

    asked, plain = [], kernels.distances
    monkeypatch.setattr(kernels, "distances", lambda p, q: asked.append(len(p) * len(q)) or plain(p, q))
    rng = np.random.default_rng(5)
    p, q = rng.random((30, 2)), 3 + rng.random((20, 2))
    p, q = p[rng.permutation(np.repeat(np.arange(30), rng.integers(1, 40, 30)))], q[rng.permutation(np.repeat(np.arange(20), rng.integers(1, 40, 20)))]
    i, j = np.arange(len(p)), len(p) + np.arange(len(q))
    for k in (Kernel("exp", 1.0), Kernel("helmholtz", 1.0, wave=2.0), Kernel("exp", 1.0, strata=(Kernel("laplace"),))):
        asked.clear()
        a, b = k.panels(p, q, i, j, method, 1e-8, 0)
        assert sum(asked) <= 4 * 30 * 20 * (1 + len(k.strata))
        m = k.block(p, q, i, j) + sum(s.block(p, q, i, j) for s in k.strata)
        s = np.linalg.svd(m, compute_uv=False)
        assert a.shape == (len(p), a.shape[1]) and b.shape == (len(q), a.shape[1]) and a.shape[1] <= (s > 1e-11 * s[0]).sum()
        assert np.linalg.norm(a @ b.T - m) <= 1e-6 * np.linalg.norm(m)
    # ids, a nugget and hints tell copies apart
    told = Kernel("user", user=lambda p, q, rows, cols: np.exp(-plain(p, q)) * (1.0 + rows[:, None] % 2))
    for k in (told, Kernel("exp", 1.0, nugget=3.0), Kernel("exp", 1.0, null_rows=lambda at, ids: ids % 3 == 0)):
        a, b = k.panels(p, q, i, j, method, 1e-10, 0)
        m = k.block(p, q, i, j)
        assert np.linalg.norm(a @ b.T - m) <= 1e-7 * np.linalg.norm(m)


@pytest.mark.parametrize("method", ["svd", "rrqr", "aca_full"])
def test_large_blocks_by_tiles(monkeypatch, method):
    """A block of more entries than ``TILE`` is never evaluated whole, but every entry of it is: one odd entry is found."""
    monkeypatch.setattr(lowrank, "TILE", 400)
    asked = np.zeros((150, 91), int)

    def odd(p, q, rows, cols):
        assert len(rows) * len(cols) <= 400
        asked[np.ix_(rows, cols)] += 1
        out = np.exp(-np.abs(p - q.T))
        out[(rows[:, None] == 77) & (cols[None, :] == 13)] += 3.0
        return out

    rng = np.random.default_rng(4)
    p, q, i, j = np.sort(rng.random((150, 1)), 0), 1 + rng.random((91, 1)), np.arange(150), np.arange(91)
    a, b = Kernel("user", user=odd).panels(p, q, i, j, method, 1e-10, 0)
    m = np.exp(-np.abs(p - q.T))
    m[77, 13] += 3.0
    assert (asked == 1).all() and a.shape[1] == 2
    assert np.linalg.norm(a @ b.T - m) <= 3e-10 * np.linalg.norm(m)
    z = Kernel("helmholtz", 1.0, wave=2.0).panels(p, q, i, j, method, 1e-8, 0)
    assert np.linalg.norm(z[0] @ z[1].T - Kernel("helmholtz", 1.0, wave=2.0).block(p, q, i, j)) <= 3e-8 * np.linalg.norm(z[0] @ z[1].T)


def test_entries_are_expanded_in_pieces(spark):
    """A rectangle, the squares on the diagonal and all entries; a large leaf is cut before it is expanded."""
    import blockwood.operators.matrix as M

    at = np.sort(np.random.default_rng(3).random(90))
    cloud = spark.createDataFrame([(i, [float(x)], [float(x)], [float(x)], None) for i, x in enumerate(at)], "dof long, coord array<double>, lo array<double>, hi array<double>, group_id int")
    m = HMatrix.build(cloud, Kernel("exp", 0.3), clustering=Clustering("median", max_leaf=12), admissibility=Admissibility("hodlr"), eps=1e-12)
    want = np.exp(-np.abs(at[:, None] - at) / 0.3)
    got = {(r.row_pos, r.col_pos): r.re for r in m.block(40, 10, 3, 50).collect()}
    assert set(got) == {(i, j) for i in range(40, 50) for j in range(3, 53)} and all(abs(v - want[k]) < 1e-9 for k, v in got.items())
    got = {(7 * r.block + r.i, 7 * r.block + r.j): r.re for r in m.diagonal_blocks(7).collect()}
    assert set(got) == {(i, j) for i in range(90) for j in range(90) if i // 7 == j // 7} and all(abs(v - want[k]) < 1e-9 for k, v in got.items())
    assert m.entries().count() == 8100
    # a leaf of 3e9 entries (24 GB if expanded) gives the rectangle asked for
    n = 55_000
    ones = np.ones(n).tobytes()
    big = spark.createDataFrame([("r0", "r1", 0, n, n, n, "rk", 1, 0.0, "D", ones, ones, None)], M.LEAF)
    wide = replace(m, leaves=big)
    assert wide.block(n - 2, 5, n, 3).count() == 6 and wide.diagonal_blocks(7).count() == (n % 7) * (7 - n % 7)


def test_gram_blocks_are_compressed_without_their_entries(monkeypatch):
    """By each method that looks at all entries; also with copies of points and a block below the number of coordinates."""
    rng = np.random.default_rng(8)
    p, q = rng.normal(size=(3000, 6)), rng.normal(size=(500, 6))
    q[100:200] = q[0]
    dense, entries, values = p @ q.T, [], Kernel._values
    monkeypatch.setattr(Kernel, "_values", lambda k, a, b, *ids: entries.append(len(a) * len(b)) or values(k, a, b, *ids))
    for method in ("svd", "rrqr", "aca_full"):
        a, b = Kernel("gram").panels(p, q, np.arange(3000), np.arange(500), method, 1e-10, 0)
        assert a.shape[1] == 6 and np.linalg.norm(a @ b.T - dense) < 1e-9 * np.linalg.norm(dense)
    assert not entries
    a, b = Kernel("gram", nugget=1.0).panels(p[:4], q[:5], np.arange(4), np.arange(10, 15), "rrqr", 1e-10, 0)
    assert np.allclose(a @ b.T, dense[:4, :5])
