"""Interactions k(p, q), evaluated on whole blocks in double precision."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lowrank


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    out = np.zeros((len(p), len(q)))
    for axis in range(p.shape[1]):  # never an array of rows x columns x axes
        out += (p[:, None, axis] - q[None, :, axis]) ** 2
    return np.sqrt(out)


def _once(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points without their copies, by first occurrence, the roots of their numbers of copies, and the place of each point among them."""
    _, first, turn, copies = np.unique(p + 0.0, axis=0, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(first)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return p[first[order]], np.sqrt(copies[order]), place[turn.ravel()]


@dataclass(frozen=True)
class Kernel:
    """``name``: exp, laplace, helmholtz, gram or a user's block function (coordinates and ids of rows and columns).

    ``strata``: further kernels whose blocks are added one by one.  ``nugget`` stands on the diagonal.
    ``null_rows`` and ``null_cols`` (coordinates and ids -> booleans) name rows and columns that are known to be zero:
    they are never evaluated, or, with ``check_nulls``, evaluated and held against zero.  ``places_alone`` tells of a user's function
    that it looks at coordinates only.  ``weighted``: the ids are factors of rows and columns (see ``panels``).
    """

    name: str
    length: float = 1.0
    wave: float = 0.0
    nugget: float = 0.0
    scale: float = 1.0
    strata: tuple[Kernel, ...] = field(default=())
    user: Callable | None = None
    null_rows: Callable | None = None
    null_cols: Callable | None = None
    check_nulls: bool = False
    places_alone: bool = False
    weighted: bool = False

    def _kept(self, p: np.ndarray, q: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the rows and columns that no hint calls zero."""
        known = [np.zeros(len(ids), bool) if hint is None else np.asarray(hint(at, ids), bool) for hint, at, ids in ((self.null_rows, p, rows), (self.null_cols, q, cols))]
        return np.flatnonzero(~known[0]), np.flatnonzero(~known[1])

    def block(self, p: np.ndarray, q: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        i, j = self._kept(p, q, rows, cols)
        if len(i) == len(rows) and len(j) == len(cols):
            return self._values(p, q, rows, cols)
        if self.check_nulls:
            out = self._values(p, q, rows, cols)
            wrong = out != 0
            wrong[np.ix_(i, j)] = False
            if wrong.any():
                raise ValueError("a row or column that a hint calls zero is not")
            return out
        some = self._values(p[i], q[j], rows[i], cols[j])
        out = np.zeros((len(rows), len(cols)), some.dtype)
        out[np.ix_(i, j)] = some
        return out

    def _values(self, p: np.ndarray, q: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        if self.name == "gram":
            out = p @ q.T
        elif self.name == "user":
            out = self.user(p, q, rows, cols)
        else:
            r = distances(p, q)
            if self.name == "exp":
                out = np.exp(-r / self.length)
            elif self.name == "laplace":
                out = 1 / (r + 1e-10)
            elif self.name == "helmholtz":
                out = np.exp(1j * self.wave * (r + 1e-10)) / (4 * np.pi * (r + 1e-10))
            else:
                raise ValueError(self.name)
        out = self.scale * out
        if self.weighted:
            out = out * rows[:, None] * cols[None, :]
        return out + self.nugget * (rows[:, None] == cols[None, :]) if self.nugget else out

    @property
    def _by_place(self) -> bool:
        """Whether points of equal coordinates have equal rows and columns, in all strata."""
        mine = (self.name != "user" or self.places_alone) and not self.nugget and self.null_rows is None and self.null_cols is None and not self.weighted
        return mine and all(k._by_place for k in self.strata)

    @property
    def has_columns(self) -> bool:
        """Whether ``column`` can evaluate the kernel and its strata: no user function and no hints."""
        plain = self.name in ("exp", "laplace", "helmholtz", "gram") and self.null_rows is None and self.null_cols is None
        return plain and all(k.has_columns for k in self.strata)

    def column(self, p: list[Column], q: list[Column], same: Column) -> tuple[Column, Column | None]:
        """Real and imaginary part (None: real kernel) for one pair of points, strata included; ``same``: the pair is on the diagonal."""
        total = lambda terms: sum(terms[1:], terms[0])
        if self.name == "gram":
            re, im = total([a * b for a, b in zip(p, q, strict=True)]), None
        else:
            r = F.sqrt(total([(a - b) * (a - b) for a, b in zip(p, q, strict=True)]))
            if self.name == "exp":
                re, im = F.exp(-r / self.length), None
            elif self.name == "laplace":
                re, im = 1 / (r + 1e-10), None
            elif self.name == "helmholtz":
                re, im = (f(self.wave * (r + 1e-10)) / (4 * np.pi * (r + 1e-10)) for f in (F.cos, F.sin))
            else:
                raise ValueError(self.name)
        re, im = self.scale * re, None if im is None else self.scale * im
        if self.nugget:
            re = re + F.when(same, F.lit(float(self.nugget))).otherwise(0.0)
        for more in self.strata:
            a, b = more.column(p, q, same)
            re, im = re + a, im if b is None else b if im is None else im + b
        return re, im

    def panels(self, p: np.ndarray, q: np.ndarray, rows: np.ndarray, cols: np.ndarray, method: str, eps: float, seed: int, least_svd: int = 0):
        """The block of the kernel and all its strata as a low-rank pair, truncated after each.

        Points that occur more than once are taken once, each row and column times the root of its copies: that block has the singular values
        and the norm of the whole one, whose panels repeat its rows.
        """
        if self._by_place:
            (p1, u, turn_p), (q1, v, turn_q) = _once(p), _once(q)
            if len(p1) < len(p) or len(q1) < len(q):
                once = replace(self, weighted=True, strata=tuple(replace(k, weighted=True) for k in self.strata))
                a, b = once.panels(p1, q1, u, v, method, eps, seed, 0 if max(len(p), len(q)) >= least_svd else 1 << 62)
                return (a / u[:, None])[turn_p], (b / v[:, None])[turn_q]
        value = self.compressed(p, q, rows, cols, method, eps, seed, least_svd)
        for more in self.strata:
            value = lowrank.add([(1, value), (1, more.compressed(p, q, rows, cols, method, eps, seed, least_svd))], eps)
        return value

    def compressed(self, p: np.ndarray, q: np.ndarray, rows: np.ndarray, cols: np.ndarray, method: str, eps: float, seed: int, least_svd: int = 0):
        """The block as a low-rank pair; cross methods evaluate the rows and columns they need, never the whole block, the others all entries, tile by tile.

        A Gram block is a product of coordinates as it stands: the other methods take it from there, without its entries.
        """
        shape = (len(rows), len(cols))
        i, j = self._kept(p, q, rows, cols)
        if (len(i), len(j)) != shape and not self.check_nulls:
            if not len(i) or not len(j):
                return lowrank.zero_rk(*shape)
            some = replace(self, null_rows=None, null_cols=None).compressed(p[i], q[j], rows[i], cols[j], method, eps, seed, least_svd)
            out = tuple(np.zeros((n, x.shape[1]), x.dtype) for n, x in zip(shape, some, strict=True))
            out[0][i], out[1][j] = some
            return out
        if self.name == "gram" and method not in lowrank.LAZY and not self.nugget and (len(i), len(j)) == shape and min(shape) > p.shape[1]:
            a, b = (p * rows[:, None], q * cols[:, None]) if self.weighted else (p, q)
            return lowrank.of_product((self.scale * a, b), "svd" if max(shape) < least_svd else method, eps)
        if method not in lowrank.LAZY or max(shape) < least_svd:
            one = lambda r, c: self.block(p[r], q[c], rows[r], cols[c])
            if shape[0] * shape[1] <= lowrank.TILE:
                return lowrank.compress(one(slice(None), slice(None)), method, eps, seed, least_svd)
            return lowrank.by_tiles(one, shape, "rrqr" if method in ("svd", *lowrank.LAZY) else method, eps)
        row = lambda i: self.block(p[i : i + 1], q, rows[i : i + 1], cols)[0]
        col = lambda j: self.block(p, q[j : j + 1], rows, cols[j : j + 1])[:, 0]
        some = lambda i, j: np.array([self.block(p[a : a + 1], q[b : b + 1], rows[a : a + 1], cols[b : b + 1])[0, 0] for a, b in zip(i, j, strict=True)])
        return lowrank.aca_lazy(method, row, col, some, shape, eps, np.complex128 if self.name == "helmholtz" else np.float64, seed)
