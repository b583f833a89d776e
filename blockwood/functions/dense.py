"""Dense kernels on NumPy arrays, real or complex; complex symmetric factorizations use the plain transpose."""

from __future__ import annotations

import numpy as np


def lower_solve(low: np.ndarray, rhs: np.ndarray, unit: bool = False) -> np.ndarray:
    """X with L X = B; only the lower triangle is read.  A zero on the diagonal is a null pivot: its row of X is 0."""
    x = np.array(rhs, dtype=np.result_type(low, rhs))
    for i in range(len(low)):
        x[i] -= low[i, :i] @ x[:i]
        if not unit:
            x[i] = x[i] / low[i, i] if low[i, i] != 0 else 0
    return x


def upper_solve(up: np.ndarray, rhs: np.ndarray, unit: bool = False) -> np.ndarray:
    """X with U X = B; only the upper triangle is read.  Null pivots as in ``lower_solve``."""
    x = np.array(rhs, dtype=np.result_type(up, rhs))
    for i in range(len(up) - 1, -1, -1):
        x[i] -= up[i, i + 1 :] @ x[i + 1 :]
        if not unit:
            x[i] = x[i] / up[i, i] if up[i, i] != 0 else 0
    return x


def trsm(tri: np.ndarray, rhs: np.ndarray, *, side: str = "L", uplo: str = "L", trans: str = "N", unit: bool = False, alpha: complex = 1) -> np.ndarray:
    """alpha op(T)^-1 B or alpha B op(T)^-1, all eight cases and conjugates."""
    op = {"N": tri, "T": tri.T, "C": tri.conj().T}[trans]
    lower = (uplo == "L") == (trans == "N")
    if side == "R":
        return trsm(op.T, np.asarray(rhs).T, side="L", uplo="U" if lower else "L", unit=unit, alpha=alpha).T
    return alpha * (lower_solve if lower else upper_solve)(op, rhs, unit)


def trmm(tri: np.ndarray, rhs: np.ndarray, *, uplo: str = "L", unit: bool = False) -> np.ndarray:
    t = np.tril(tri) if uplo == "L" else np.triu(tri)
    if unit:
        np.fill_diagonal(t, 1)
    return t @ rhs


def lu(a: np.ndarray, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(L and U in one array, row order): a[order] = L U, with partial pivoting.

    Pivots of at most ``least`` > 0 are null if ``a`` is symmetric: it is then factored in its own order, and their columns of L and rows of U are zero.
    """
    full, a, order = np.asarray(a), np.array(a), np.arange(len(a))
    for k in range(len(a)):
        p = k + int(np.argmax(np.abs(a[k:, k])))
        if abs(a[p, k]) <= least:
            if least > 0 and np.abs(full - full.T).max() <= least:
                low, d = ldlt(full, least)
                return np.tril(low, -1) + d[:, None] * low.T, np.arange(len(a))
            raise ZeroDivisionError("singular block")
        if p != k:
            a[[k, p]], order[[k, p]] = a[[p, k]], order[[p, k]]
        a[k + 1 :, k] /= a[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])
    return a, order


def lu_solve(factor: tuple[np.ndarray, np.ndarray], rhs: np.ndarray) -> np.ndarray:
    if len(factor[1]) < len(factor[0]):  # a pseudo-inverse
        return factor[0] @ np.asarray(rhs)
    return upper_solve(factor[0], lower_solve(factor[0], np.asarray(rhs)[factor[1]], unit=True))


def lu_or_pinv(a: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, float]:
    """What ``lu_solve`` takes and log |det a|; if a pivot is at most ``least`` > 0, the pseudo-inverse beyond ``least`` with an empty order."""
    try:
        low, order = lu(a, 0.0)
        if not len(a) or np.abs(np.diag(low)).min() > least:
            return low, order, float(np.log(np.abs(np.diag(low))).sum())
    except ZeroDivisionError:
        if least == 0:
            raise
    u, s, vh = np.linalg.svd(a)
    keep = s > least
    return (vh[keep].conj().T / s[keep]) @ u[:, keep].conj().T, np.zeros(0, np.int64), float("-inf") if not keep.all() else float(np.log(s).sum())


def ldlt(a: np.ndarray, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Unit lower L and diagonal d with A = L diag(d) L^T; no pivoting, error on a zero pivot.

    With ``least`` > 0 pivots of at most that modulus are null: their d is 0 and their column of L a unit vector, which
    is right where ``a`` is semidefinite.
    """
    n, low, d = len(a), np.eye(len(a), dtype=a.dtype), np.zeros(len(a), a.dtype)
    for j in range(n):
        d[j] = a[j, j] - (low[j, :j] ** 2) @ d[:j]
        if abs(d[j]) <= least:
            if least == 0:
                raise ZeroDivisionError("zero pivot")
            d[j] = 0
            rest = a[j + 1 :, j] - low[j + 1 :, :j] @ (low[j, :j] * d[:j])
            # |a_ij|^2 <= a_ii a_jj in a semidefinite remainder
            if len(rest) and (np.abs(rest) ** 2).max() > 4 * least * max(least, np.abs(np.diag(a)).max()):
                raise ZeroDivisionError("zero pivot of an indefinite block")
            continue
        low[j + 1 :, j] = (a[j + 1 :, j] - low[j + 1 :, :j] @ (low[j, :j] * d[:j])) / d[j]
    return low, d


def llt(a: np.ndarray, least: float = 0.0) -> np.ndarray:
    """Lower L with A = L L^T (plain transpose, also for complex symmetric A); columns of null pivots (see ``ldlt``) are zero."""
    if not np.iscomplexobj(a):
        try:
            low = np.linalg.cholesky(a)
            if not len(a) or np.diag(low).min() ** 2 > least:
                return low
        except np.linalg.LinAlgError:
            if least == 0:
                raise
    low, d = ldlt(a, least)
    if not np.iscomplexobj(a) and (d < 0).any():
        raise np.linalg.LinAlgError("Matrix is not positive definite")
    return low * np.sqrt(d)


def pivoted_qr(a: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Q, R and column order with a[:, order] ~ Q R; stops once the remainder's norm is at most eps times the first."""
    a = np.array(a)
    m, n = a.shape
    order, q_columns, rows = np.arange(n), [], []
    norms = (np.abs(a) ** 2).sum(0)
    whole = norms.sum()
    for k in range(min(m, n)):
        if norms[k:].sum() <= (eps**2) * whole:
            break
        p = k + int(np.argmax(norms[k:]))
        if p != k:
            a[:, [k, p]], order[[k, p]], norms[[k, p]] = a[:, [p, k]], order[[p, k]], norms[[p, k]]
            for r in rows:
                r[[k, p]] = r[[p, k]]
        v = a[:, k].copy()
        for q in q_columns:  # once more against rounding
            v -= q * np.vdot(q, v)
        size = np.linalg.norm(v)
        if size == 0:
            break
        q = v / size
        r = np.zeros(n, a.dtype)
        r[k:] = q.conj() @ a[:, k:]
        a[:, k:] -= np.outer(q, r[k:])
        norms[k + 1 :] = (np.abs(a[:, k + 1 :]) ** 2).sum(0)
        norms[k] = 0
        q_columns.append(q)
        rows.append(r)
    if not rows:
        return np.zeros((m, 0), a.dtype), np.zeros((0, n), a.dtype), order
    return np.stack(q_columns, axis=1), np.stack(rows), order


def rank_by(sigma: np.ndarray, eps: float, by_sum: bool = False) -> int:
    """Number of singular values strictly above eps times the largest (or their sum)."""
    if not len(sigma) or sigma[0] == 0:
        return 0
    return int((sigma > eps * (sigma.sum() if by_sum else sigma[0])).sum())
