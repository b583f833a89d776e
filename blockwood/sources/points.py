"""Point sets: (dof, coord[, lo, hi, group_id]) from tables, files and formulas."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def points(df: DataFrame, dof: str, coords: list[str | Column], group: str | None = None) -> DataFrame:
    """Any table as points: the span of a plain point is the point itself."""
    cells = [F.col(c) if isinstance(c, str) else c for c in coords]
    coord = F.array(*[c.cast("double") for c in cells])
    out = df.select(F.col(dof).cast("long").alias("dof"), coord.alias("coord"), (F.col(group).cast("int") if group else F.lit(None).cast("int")).alias("group_id"))
    return out.select("dof", "coord", F.col("coord").alias("lo"), F.col("coord").alias("hi"), "group_id")


def vectors(df: DataFrame, dof: str, vector: str) -> DataFrame:
    """Points whose coordinates are an array column."""
    coord = F.col(vector).cast("array<double>")
    return df.select(F.col(dof).cast("long").alias("dof"), coord.alias("coord"), coord.alias("lo"), coord.alias("hi"), F.lit(None).cast("int").alias("group_id"))


def spans(df: DataFrame, dof: str, coords: list[str], group: str | None = None) -> DataFrame:
    """Several rows per dof: its span is their bounding box, its coordinate the middle of it."""
    aggs = [F.min(F.col(c).cast("double")).alias(f"lo{i}") for i, c in enumerate(coords)] + [F.max(F.col(c).cast("double")).alias(f"hi{i}") for i, c in enumerate(coords)]
    out = df.groupBy(F.col(dof).cast("long").alias("dof")).agg(*aggs, (F.min(group).cast("int") if group else F.lit(None).cast("int")).alias("group_id"))
    lo, hi = F.array(*[F.col(f"lo{i}") for i in range(len(coords))]), F.array(*[F.col(f"hi{i}") for i in range(len(coords))])
    return out.select("dof", F.zip_with(lo, hi, lambda a, b: (a + b) / 2).alias("coord"), lo.alias("lo"), hi.alias("hi"), "group_id")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One point per line, numbers between white space; dof counts the lines that are not blank, file by file in the order of their names.

    A file may be read in several splits: the lines before each are counted, and the driver holds no row of either.
    """
    rows = spark.read.text(path).where(F.trim("value") != "")
    rows = rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    parts = rows.groupBy("file", "start").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    parts = parts.select("file", "start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rows = rows.join(parts, ["file", "start"]).withColumn("dof", F.col("before") + F.col("at") - F.col("first"))
    coord = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double"))
    return rows.select("dof", coord.alias("coord"), coord.alias("lo"), coord.alias("hi"), F.lit(None).cast("int").alias("group_id"))


def write_text(df: DataFrame, path: str) -> None:
    df.orderBy("dof").select(F.array_join(F.transform("coord", lambda x: x.cast("string")), " ").alias("value")).write.text(path)


def cylinder(spark: SparkSession, n: int, radius: float = 1.0) -> DataFrame:
    """n points winding up a cylinder, about evenly spaced."""
    step = 1.75 * math.pi * radius / math.sqrt(n)
    turn = math.floor(2 * math.pi * radius / step)
    angle = F.col("id") * (2 * math.pi / turn)
    coord = F.array(radius * F.cos(angle), radius * F.sin(angle), F.col("id") * (step / turn))
    return spark.range(n).select(F.col("id").alias("dof"), coord.alias("coord"), coord.alias("lo"), coord.alias("hi"), F.lit(None).cast("int").alias("group_id"))


def correlation_length(df: DataFrame, share: float = 0.1) -> float:
    """``share`` of the largest extent over the axes."""
    size = df.select(F.size("coord")).limit(1).first()
    if size is None:
        return 0.0
    row = df.agg(*[(F.max(F.col("coord")[i]) - F.min(F.col("coord")[i])).alias(f"e{i}") for i in range(size[0])]).first()
    return share * max(row)


def right_hand_side(df: DataFrame, length: float) -> DataFrame:
    """exp(-|p - centre| / length) of each point: (dof, rhs, re)."""
    size = df.select(F.size("coord")).first()[0]
    centre = df.agg(*[F.avg(F.col("coord")[i]).alias(f"c{i}") for i in range(size)]).first()
    distance = F.sqrt(sum(((F.col("coord")[i] - float(centre[i])) ** 2 for i in range(size)), F.lit(0.0)))
    return df.select("dof", F.lit(0).alias("rhs"), F.exp(-distance / length).alias("re"))
