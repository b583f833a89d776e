"""Cutting lineage: shared folder, written tables, small local tables."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session, which has one machine, gets one here if it has none."""
    context = spark.sparkContext
    where = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = os.path.join(tempfile.gettempdir(), "checkpoints")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(where)
    return where


class Scratch:
    """Collects the tables that ``settle`` writes while it is open (a context manager); ``drop`` deletes them.

    Results are read from those tables lazily: drop them once the result is written or collected.
    """

    open: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        Scratch.open.append(self)
        return self

    def __exit__(self, *_) -> None:
        Scratch.open.remove(self)

    def drop(self) -> None:
        for path in self.paths:
            delete(self.spark, path)
        self.paths.clear()


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``settle`` or a caller wrote."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def settle(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again.

    Lineage ends in those files, so a lost executor costs no recomputation of what came
    before, and later readers take only the columns they use.  ``discard`` or a ``Scratch`` deletes them.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark).rstrip('/')}/blockwood/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if Scratch.open:
        Scratch.open[-1].paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def sweep(spark: SparkSession) -> None:
    """Has the driver collect its garbage: Spark's cleaner then deletes shuffle files that no plan can read any more."""
    for _ in range(2):  # the first round frees what Python held
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def discard(*tables: DataFrame) -> None:
    """Deletes settled tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_settled_at", None):
            delete(df.sparkSession, path)


def cut_rows(df: DataFrame, most: int = 20_000, bound: int | None = None) -> tuple[DataFrame, pa.Table | None]:
    """As ``cut``, and the rows themselves if they are local.  A known ``bound`` on their number saves the jobs of a limit.

    Written tables ask for merge joins: Spark would go by the size of their files, which hold repeated values in a fraction of what the
    rows take in memory, and send them whole through the driver.
    """
    rows = (df if bound is not None and bound <= most else df.limit(most + 1)).toArrow()
    if rows.num_rows > most:
        out = settle(df)
        where, out = out._settled_at, out.hint("merge")
        out._settled_at = where
        return out, None
    return df.sparkSession.createDataFrame(rows, df.schema), rows


def cut(df: DataFrame, most: int = 20_000, bound: int | None = None) -> DataFrame:
    """``df`` without its lineage: a local table if it has at most ``most`` rows, else a written one.  For rows of metadata only."""
    return cut_rows(df, most, bound)[0]
