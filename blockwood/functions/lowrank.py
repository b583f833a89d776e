"""Low-rank blocks a b^T (plain transpose): compression, truncation, sums and products."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .dense import pivoted_qr, rank_by

Rk = tuple[np.ndarray, np.ndarray]
METHODS = ("svd", "aca_full", "aca_partial", "aca_plus", "aca_random", "rrqr")


def zero_rk(rows: int, cols: int, kind=np.float64) -> Rk:
    return np.zeros((rows, 0), kind), np.zeros((cols, 0), kind)


def svd(m: np.ndarray, eps: float) -> Rk:
    if 0 in m.shape:
        return zero_rk(*m.shape, m.dtype)
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    k = rank_by(s, eps)
    root = np.sqrt(s[:k])
    return u[:, :k] * root, vt[:k].T * root


class Crosses:
    """A growing sum of crosses (column times row), stored so that remainders of single rows and columns are one product."""

    def __init__(self, row_of: Callable, col_of: Callable, shape: tuple[int, int], kind):
        self.of, self.shape, self.kind, self.rank, self.size = (row_of, col_of), shape, kind, 0, 0.0
        self._parts = tuple(np.zeros((8, n), kind) for n in shape)

    @property
    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """Columns and rows so far, one a line."""
        return self._parts[0][: self.rank], self._parts[1][: self.rank]

    def remainder(self, side: int, i: int) -> np.ndarray:
        """What row i (side 0) or column i (side 1) has beyond the crosses."""
        mine, other = self.parts[side], self.parts[1 - side]
        return self.of[side](i) - mine[:, i] @ other

    def step(self, col: np.ndarray, row: np.ndarray, eps: float) -> bool:
        """Whether a cross is small against the sum."""
        return self.rank > 0 and np.linalg.norm(col) * np.linalg.norm(row) <= eps * np.sqrt(max(self.size, 0))

    def add(self, col: np.ndarray, row: np.ndarray) -> None:
        cols, rows = self.parts
        overlap = ((cols.conj() @ col) * (rows.conj() @ row)).sum().real
        self.size += 2 * float(overlap) + float(np.linalg.norm(col) ** 2 * np.linalg.norm(row) ** 2)
        if self.rank == len(self._parts[0]):
            self._parts = tuple(np.concatenate([p, np.zeros_like(p)]) for p in self._parts)
        for p, x in zip(self._parts, (col, row), strict=True):
            p[self.rank] = x
        self.rank += 1

    def result(self) -> Rk:
        return tuple(np.ascontiguousarray(p.T) for p in self.parts)


def aca_full(m: np.ndarray, eps: float) -> Rk:
    """Cross approximation with the largest entry of the remainder as pivot."""
    rest = np.array(m)
    found = Crosses(None, None, m.shape, m.dtype)
    for _ in range(min(m.shape)):
        i, j = np.unravel_index(int(np.argmax(np.abs(rest))), rest.shape)
        if rest[i, j] == 0:
            break
        col, row = rest[:, j].copy(), rest[i] / rest[i, j]
        rest -= np.outer(col, row)
        found.add(col, row)
        if np.linalg.norm(rest) <= eps * np.sqrt(max(found.size, 0)):
            break
    return found.result()


def _crosses(row_of: Callable, col_of: Callable, shape: tuple[int, int], eps: float, kind, start: int, samples: tuple | None = None) -> Rk:
    """Cross approximation from single rows and columns.

    The next row is where the last column's remainder is largest.  ``samples`` (rows, columns,
    values) are entries that must be small before it ends; the largest one takes over as pivot.
    """
    n, m = shape
    found = Crosses(row_of, col_of, shape, kind)
    free, i, small, top = np.ones(n, bool), start, 0, 0.0
    rest = None if samples is None else samples[2].copy()
    while found.rank < min(n, m) and free.any():
        free[i] = False
        row = found.remainder(0, i)
        j = int(np.argmax(np.abs(row)))
        last, zero = None, np.abs(row[j]) <= 1e-15 * top
        if not zero:
            top = max(top, float(np.abs(row[j])))
            row = row / row[j]
            last = found.remainder(1, j)
            tiny = found.step(last, row, eps)
            # two small crosses in a row end it, as one may come from an unlucky row
            small = small + 1 if tiny else 0
            if not tiny:
                found.add(last, row)
                if rest is not None:
                    rest = rest - last[samples[0]] * row[samples[1]]
        done = zero or small >= 2
        if done and rest is not None:
            worst = int(np.argmax(np.abs(rest)))
            if np.abs(rest[worst]) > eps * np.sqrt(max(found.size, 0) / (n * m)) and free[samples[0][worst]]:
                i, small = int(samples[0][worst]), 0
                continue
        if done and small >= 2 or not free.any():
            break
        i = int(np.flatnonzero(free)[0]) if last is None else int(np.argmax(np.where(free, np.abs(last), -1)))
    return found.result()


LAZY = ("aca_partial", "aca_plus", "aca_random")


def aca_lazy(method: str, row_of: Callable, col_of: Callable, entries_of: Callable, shape: tuple[int, int], eps: float, kind, seed: int = 0) -> Rk:
    """Cross approximation that asks for single rows, columns and entries only.

    aca_plus steers by a reference row and column (``aca_plus``); aca_random checks itself on max(rows, columns) random entries, from a fixed seed.
    """
    if method == "aca_plus":
        return aca_plus(row_of, col_of, shape, eps, kind)
    if method == "aca_random":
        rng, count = np.random.default_rng(seed), max(shape)
        i, j = rng.integers(0, shape[0], count), rng.integers(0, shape[1], count)
        return _crosses(row_of, col_of, shape, eps, kind, 0, (i, j, entries_of(i, j)))
    return _crosses(row_of, col_of, shape, eps, kind, 0)


def aca_plus(row_of: Callable, col_of: Callable, shape: tuple[int, int], eps: float, kind) -> Rk:
    """Cross approximation steered by a reference row and a reference column (Grasedyck 2005, Bebendorf 2008).

    Both remainders are state: ``at[0]`` and ``seen[0]`` of the reference row, ``at[1]`` and ``seen[1]`` of the reference column.  The side whose
    remainder has the larger entry proposes a cross.  Afterwards a reference that lies on the cross is replaced by an unused index
    where the other reference is least (columns first), and is read anew; the other one loses what the cross took.
    """
    found = Crosses(row_of, col_of, shape, kind)
    unused = [np.ones(k, bool) for k in shape]
    top = 0.0

    def least(side: int, by: np.ndarray) -> int:
        """The unused row (side 0) or column where a vector over rows or columns is least."""
        return int(np.argmin(np.where(unused[side], np.abs(by), np.inf)))

    def proposed(side: int) -> tuple[list[int], list[np.ndarray]]:
        """A cross from one side's remainder: (row, column) of the pivot, and the remainders of that row and column."""
        other = int(np.argmax(np.abs(seen[side])))
        across = found.remainder(1 - side, other)
        mine = int(np.argmax(np.abs(across)))
        along = found.remainder(side, mine)
        return ([mine, other], [along, across]) if side == 0 else ([other, mine], [across, along])

    at = [0, shape[1] // 2]
    seen = [None, found.remainder(1, at[1])]
    at[0] = least(0, seen[1])
    seen[0] = found.remainder(0, at[0])
    while found.rank < min(shape):
        sizes = [float(np.abs(v).max()) for v in seen]
        top = max(top, *sizes)
        side = int(sizes[1] >= sizes[0])
        if sizes[side] <= 1e-15 * top:
            # nothing left on either: other rows, all of them as long as there is no cross, else three
            for i in np.flatnonzero(unused[0])[: 3 if found.rank else None]:
                unused[0][i] = False
                at[0], seen[0], side = int(i), found.remainder(0, int(i)), 0
                if np.abs(seen[0]).max() > 1e-15 * top:
                    break
            else:
                break
        pivot, (row, col) = proposed(side)
        if row[pivot[1]] == 0:
            break
        top = max(top, float(np.abs(row[pivot[1]])))
        row = row / row[pivot[1]]
        last = found.step(col, row, eps)
        if found.step(col, row, max(1e-3 * eps, 1e-14)):  # rounding of the crosses before: no rank of its own
            break
        found.add(col, row)
        for k in (0, 1):
            unused[k][pivot[k]] = False
        if last or not unused[0].any() or not unused[1].any():
            break
        stale = [pivot[k] == at[k] for k in (0, 1)]
        took = (col[at[0]] * row, row[at[1]] * col)
        for k in (1, 0):
            if not stale[k]:
                seen[k] = seen[k] - took[k]
        for k in (1, 0):
            if stale[k]:
                # a reference runs along the other axis: seen[1 - k] is a vector over the indices of side k
                at[k] = int(np.argmax(unused[k])) if stale[1 - k] and k == 1 else least(k, seen[1 - k])
                seen[k] = found.remainder(k, at[k])
    return found.result()


def rrqr(m: np.ndarray, eps: float) -> Rk:
    q, r, order = pivoted_qr(m, eps)
    b = np.zeros((m.shape[1], q.shape[1]), m.dtype)
    b[order] = r.T
    return q, b


def compress(m: np.ndarray, method: str, eps: float, seed: int = 0, least_svd: int = 0) -> Rk:
    """A block by the named method; blocks below ``least_svd`` rows and columns always by SVD."""
    if 0 in m.shape:
        return zero_rk(*m.shape, m.dtype)
    if max(m.shape) < least_svd:
        return svd(m, eps)
    if method in LAZY:
        return aca_lazy(method, lambda i: m[i], lambda j: m[:, j], lambda i, j: m[i, j], m.shape, eps, m.dtype, seed)
    return {"svd": svd, "aca_full": aca_full, "rrqr": rrqr}[method](m, eps)


TILE = 1 << 18  # entries of a block that are held at once


def by_tiles(values: Callable, shape: tuple[int, int], method: str, eps: float) -> Rk:
    """A block whose entries ``values(rows, columns)`` are all looked at, but held a tile at a time, by SVD in the end.

    The block is halved until a half has at most ``TILE`` entries, halves are compressed by ``method`` and joined in pairs, each to a tenth of the
    precision (at least 1e-14): halves share no entry, so the errors of one level add up to no more than that share of the block's norm.
    """
    fine = max(0.1 * eps, 1e-14)

    def part(rows: slice, cols: slice) -> Rk:
        n, m = rows.stop - rows.start, cols.stop - cols.start
        if n * m <= TILE:
            return truncate(compress(values(rows, cols), method, 0.1 * fine), fine)
        side = int(m > n)
        long_ = (rows, cols)[side]
        middle = (long_.start + long_.stop) // 2
        halves = [part(*((s, cols) if side == 0 else (rows, s))) for s in (slice(long_.start, middle), slice(middle, long_.stop))]
        return truncate(joined(halves, side), fine)

    return truncate(part(slice(0, shape[0]), slice(0, shape[1])), eps)


def joined(halves: list[Rk], side: int) -> Rk:
    """Two blocks one below (side 0) or beside (side 1) the other as one."""
    (x, y), flat = [h[side] for h in halves], np.concatenate([h[1 - side] for h in halves], axis=1)
    tall = np.zeros((len(x) + len(y), x.shape[1] + y.shape[1]), np.result_type(x, y))
    tall[: len(x), : x.shape[1]], tall[len(x) :, x.shape[1] :] = x, y
    return (tall, flat) if side == 0 else (flat, tall)


def of_product(x: Rk, method: str, eps: float) -> Rk:
    """a b^T by the named method: on the small middle between orthonormal bases of both panels, which has its singular values and norm."""
    (qa, ra), (qb, rb) = (np.linalg.qr(p) for p in x)
    a, b = compress(ra @ rb.T, method, eps)
    return qa @ a, qb @ b


def truncate(x: Rk, eps: float) -> Rk:
    """QR of both panels, SVD of the small middle, cut; negative eps leaves the block as it is."""
    a, b = x
    if eps < 0 or a.shape[1] == 0:
        return x
    if a.shape[1] > min(len(a), len(b)):
        return svd(a @ b.T, eps)
    qa, ra = np.linalg.qr(a)
    qb, rb = np.linalg.qr(b)
    u, s, vt = np.linalg.svd(ra @ rb.T, full_matrices=False)
    k = rank_by(s, eps)
    root = np.sqrt(s[:k])
    return qa @ (u[:, :k] * root), qb @ (vt[:k].T * root)


def truncate_mgs(x: Rk, eps: float) -> Rk:
    """As ``truncate``, with pivoted orthogonalisation of both panels (precision at least 1e-6 finer)."""
    a, b = x
    qa, ra, pa = pivoted_qr(a, min(eps, 1) * 1e-6)
    qb, rb, pb = pivoted_qr(b, min(eps, 1) * 1e-6)
    fa, fb = np.zeros_like(ra), np.zeros_like(rb)
    fa[:, pa], fb[:, pb] = ra, rb
    u, s, vt = np.linalg.svd(fa @ fb.T, full_matrices=False)
    k = rank_by(s, eps)
    return qa @ (u[:, :k] * s[:k]), qb @ vt[:k].T


def add(parts: list[tuple[complex, Rk]], eps: float) -> Rk:
    """sum of alpha * a b^T, panels side by side, truncated if there is more than one."""
    a = np.concatenate([c * x[0] for c, x in parts], axis=1)
    b = np.concatenate([x[1] for _, x in parts], axis=1)
    return truncate((a, b), eps) if len(parts) > 1 else (a, b)


def norm_squared(x: Rk) -> float:
    a, b = x
    return float(((a.conj().T @ a) * (b.conj().T @ b)).sum().real) if a.shape[1] else 0.0
