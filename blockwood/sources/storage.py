"""Saving and loading matrices as Parquet tables, and their description as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matrix import HMatrix

STRUCTURE = ("row_nodes", "row_perm", "col_nodes", "col_perm", "blocks")


def write_structure(m: HMatrix, path: str) -> None:
    for name in STRUCTURE:
        getattr(m, name).write.mode("overwrite").parquet(f"{path}/{name}")
    m.blocks.sparkSession.createDataFrame([(m.symmetric,)], "symmetric boolean").write.mode("overwrite").parquet(f"{path}/flags")


def write_data(m: HMatrix, path: str) -> None:
    m.leaves.write.mode("overwrite").parquet(f"{path}/leaves")


def read(spark: SparkSession, path: str) -> HMatrix:
    flags = spark.read.parquet(f"{path}/flags").first()
    return HMatrix(*[spark.read.parquet(f"{path}/{n}") for n in STRUCTURE], spark.read.parquet(f"{path}/leaves"), flags["symmetric"])


def describe(m: HMatrix) -> DataFrame:
    """One JSON text per block: place, kind, rank and eps."""
    rows = m.blocks.join(m.leaves.select("r", "c", "rank", "eps"), ["r", "c"], "left")
    return rows.select("r", "c", F.to_json(F.struct("r", "c", "depth", "r_off", "r_n", "c_off", "c_n", "kind", "rank", "eps")).alias("json"))


def describe_tree(nodes: DataFrame, perm: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One JSON text per cluster (place, size, boxes) and one per point (internal place, id, coordinates, leaf)."""
    clusters = nodes.select("path", F.to_json(F.struct("path", "parent", "depth", "off", "n", "axis", "bb_min", "bb_max", "is_leaf")).alias("json"))
    return clusters, perm.select("pos", F.to_json(F.struct("pos", "dof", "coord", "leaf")).alias("json"))


def dump(m: HMatrix, path: str) -> None:
    """Blocks, clusters, points and mapping of rows and columns as folders of JSON lines."""
    describe(m).select("json").write.mode("overwrite").text(f"{path}/blocks")
    for side, nodes, perm in (("rows", m.row_nodes, m.row_perm), ("columns", m.col_nodes, m.col_perm)):
        for name, table in zip(("clusters", "points"), describe_tree(nodes, perm), strict=True):
            table.select("json").write.mode("overwrite").text(f"{path}/{side}/{name}")
