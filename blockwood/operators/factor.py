"""Factors that are kept: computed once, saved, applied and solved with as often as wanted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hodlr, tiles
from .matrix import HMatrix

KINDS = ("lu", "llt", "ldlt", "hodlr", "hodlrsym")


def _conjugate(x: DataFrame) -> DataFrame:
    return x.withColumn("im", -F.col("im")) if "im" in x.columns else x


@dataclass(frozen=True)
class Factor:
    """``tables``: what the factor consists of (see ``tiles.factor`` and ``hodlr.factor``).

    kind is lu (rows exchanged inside diagonal tiles only), llt, ldlt (both of the lower half), hodlr (Woodbury) or hodlrsym
    (A = L W W^T L^T).  Complex factorizations use the plain transpose; hodlrsym is real.  Work is spread over strips of up to
    ``strip_points`` points: a task holds a tile of that side, or a strip's diagonal block and panels.

    ``null_pivots`` is for symmetric semidefinite matrices, such as kernels over points that occur more than once: pivots of at most that
    times the largest diagonal entry are skipped, ``times`` still gives A x, and ``solve`` gives one of the solutions if b has any.
    """

    kind: str
    tables: dict[str, DataFrame]

    @staticmethod
    def of(m: HMatrix, kind: str, eps: float = 1e-12, strip_points: int | None = None, null_pivots: float = 0.0) -> Factor:
        if kind not in KINDS:
            raise ValueError(f"{kind} is none of {KINDS}")
        if kind == "lu" and m.symmetric:
            raise ValueError("lu needs both halves of the matrix")
        if kind.startswith("hodlr"):
            return Factor(kind, hodlr.factor(m, kind, strip_points or 512, null_pivots))
        return Factor(kind, tiles.factor(m, kind, eps, strip_points or 1024, null_pivots))

    def solve(self, b: DataFrame, part: str = "both", op: str = "N") -> DataFrame:
        """x with op(A) x = b; ``part`` lower or upper solves with that factor alone (L and L^T of the symmetric kinds)."""
        kind = self.kind
        if kind == "hodlr" and part != "both":
            raise ValueError("a hodlr factor has no parts")
        if op == "C":
            return _conjugate(self.solve(_conjugate(b), part, "T"))
        if not kind.startswith("hodlr"):
            return tiles.of_vectors(self.tables, b, lambda x, scalar: tiles.solve(self.tables, kind, x, scalar, part, op))
        if kind == "hodlr":
            return hodlr.apply(self.tables, kind, b, ["solve"])
        turn = {"N": {"lower": "half_solve", "upper": "half_solve_t"}, "T": {"lower": "half_solve_t", "upper": "half_solve"}}[op]
        return hodlr.apply(self.tables, kind, b, ["half_solve", "half_solve_t"] if part == "both" else [turn[part]])

    def trsm(self, x: DataFrame, *, side: str = "L", uplo: str = "L", trans: str = "N", unit: bool | None = None, alpha: complex = 1) -> DataFrame:
        """alpha op(T)^-1 X, or alpha X op(T)^-1 for rows of X given as right-hand sides, with a triangular part of an lu, llt or ldlt factor."""
        kind = self.kind
        if kind not in ("lu", "llt", "ldlt") or (uplo == "U" and kind != "lu"):
            raise ValueError(f"a {kind} factor has no such part")
        ones = (kind == "ldlt" or (kind == "lu" and uplo == "L")) if unit is None else unit
        if side == "R" and trans == "C":  # X T^-H = conj(conj(X) T^-T), solved from the left with T
            return _scaled(_conjugate(self.trsm(_conjugate(x), uplo=uplo, unit=ones)), alpha)
        op = {"N": "T", "T": "N"}[trans] if side == "R" else trans
        return _scaled(tiles.of_vectors(self.tables, x, lambda p, scalar: tiles.triangular(self.tables, p, scalar, uplo, op, ones)), alpha)

    def times(self, x: DataFrame) -> DataFrame:
        """A x from the factors: L U x, L L^T x, L D L^T x, or L W W^T L^T x."""
        kind = self.kind
        if kind == "hodlr":
            raise ValueError("a hodlr factor only solves")
        if kind == "hodlrsym":
            return hodlr.apply(self.tables, kind, x, ["half_times_t", "half_times"])
        return tiles.of_vectors(self.tables, x, lambda p, scalar: tiles.times(self.tables, kind, p, scalar))

    def log_determinant(self) -> DataFrame:
        """One row: logdet (of A, its modulus) and factor_logdet (of the stored triangular factor alone)."""
        return hodlr.log_determinant(self.tables) if self.kind.startswith("hodlr") else tiles.log_determinant(self.tables, self.kind)

    def inverse_parts(self) -> DataFrame:
        """A^-1 as dense blocks (``product.PART``), from the columns of the identity, a strip of them at a time."""
        if self.kind.startswith("hodlr"):
            raise ValueError("the inverse comes from tiles")
        return tiles.inverse_parts(self.tables, self.kind)

    def save(self, path: str) -> None:
        for name, table in self.tables.items():
            table.withColumn("_factor", F.lit(self.kind)).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Factor:
        first = spark.read.parquet(f"{path}/strips").select("_factor").first()
        kind = first["_factor"] if first else "lu"
        names = {"lu": ("places", "strips", "diagonal", "low", "up"), "llt": ("places", "strips", "diagonal", "low")}
        names |= {"ldlt": names["llt"], "hodlr": ("places", "strips", "panels", "cores"), "hodlrsym": ("places", "strips", "panels", "cores")}
        return Factor(kind, {n: spark.read.parquet(f"{path}/{n}").drop("_factor") for n in names[kind]})


def _scaled(x: DataFrame, alpha: complex) -> DataFrame:
    a = complex(alpha)
    if a == 1:
        return x
    return x.select("dof", "rhs", (a.real * F.col("re") - a.imag * F.col("im")).alias("re"), (a.real * F.col("im") + a.imag * F.col("re")).alias("im"))
