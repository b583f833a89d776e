"""Work on cluster trees (nodes, perm): walks, parts, moved dofs, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import settle

# a path continues with one of 0-9, a-z for each child: what follows decides where a node stands among its descendants
_AFTER = {"pre": "", "in": "0~", "post": "~"}


def walk(nodes: DataFrame, order: str = "pre") -> DataFrame:
    """``nodes`` with ``step``, the place of each in the walk: ``pre`` (before its children), ``in`` (after its first child), ``post`` (after all) or ``leaf`` (leaves alone).

    One sort over the cluster; places follow from the sizes of its partitions.
    """
    if order == "leaf":
        nodes, order = nodes.where("is_leaf"), "pre"
    tall = settle(nodes.orderBy(F.concat("path", F.lit(_AFTER[order]))).withColumn("_at", F.monotonically_increasing_id()))
    tall = tall.withColumn("_part", F.shiftright("_at", 33))
    sizes = tall.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b._part") < F.col("a._part"), "left").groupBy("a._part").agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_before"))  # a row for each partition
    return tall.join(F.broadcast(before), "_part").withColumn("step", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_at", "_before")


def subtree(nodes: DataFrame, perm: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """The cluster ``path`` with all below it, and its positions; a node that does not exist gives two empty tables."""
    return nodes.where(F.col("path").startswith(path)), perm.where(F.col("leaf").startswith(path))


def children(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where(F.col("parent") == path)


def indices(perm: DataFrame, path: str) -> DataFrame:
    """(pos, dof) of the cluster ``path``."""
    return perm.where(F.col("leaf").startswith(path)).select("pos", "dof")


def move_dof(nodes: DataFrame, perm: DataFrame, path: str, pos: int) -> tuple[DataFrame, DataFrame]:
    """The tree with the dof at ``pos`` moved from the leaf ``path`` to the leaf that follows it under the same parent.

    It changes places with the last dof of its leaf, and the boundary moves before it.  The boxes of the two leaves are those of their points.
    """
    leaf = nodes.where((F.col("path") == path) & F.col("is_leaf")).select("parent", "off", "n").first()
    if leaf is None or not leaf["off"] <= pos < leaf["off"] + leaf["n"]:
        raise ValueError(f"{path} is no leaf that holds position {pos}")
    end = leaf["off"] + leaf["n"]
    right = nodes.where((F.col("parent") == leaf["parent"]) & (F.col("off") == end) & F.col("is_leaf") & (F.col("n") > 0)).select("path").first()
    if right is None:
        raise ValueError(f"no leaf follows {path}")
    place = F.when(F.col("pos") == pos, F.lit(end - 1)).when(F.col("pos") == end - 1, F.lit(pos)).otherwise(F.col("pos"))
    perm = perm.withColumn("leaf", F.when(F.col("pos") == pos, F.lit(right["path"])).otherwise(F.col("leaf"))).withColumn("pos", place.cast("long"))
    both = F.col("path").isin(path, right["path"])
    cells = perm.where(F.col("leaf").isin(path, right["path"])).select(F.col("leaf").alias("path"), F.posexplode("coord").alias("axis", "x"))
    boxes = cells.groupBy("path", "axis").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("axis", "lo", "hi"))).alias("box"))
    changed = nodes.where(both).join(boxes, "path", "left")
    on_left = F.col("path") == path
    changed = changed.withColumns({
        "off": F.when(on_left, F.col("off")).otherwise(F.col("off") - 1), "n": F.when(on_left, F.col("n") - 1).otherwise(F.col("n") + 1),
        "bb_min": F.coalesce(F.col("box.lo"), F.col("bb_min")), "bb_max": F.coalesce(F.col("box.hi"), F.col("bb_max")),
    })
    return nodes.where(~both).unionByName(changed.select(nodes.columns)), perm


def check(nodes: DataFrame, perm: DataFrame) -> DataFrame:
    """One row: points, distinct dofs, positions out of 0 .. n - 1 or taken twice, dofs out of their leaf, and nodes that their children do not fill; valid trees have ``n = dofs`` and zeros."""
    total = nodes.where("parent is null").select(F.col("off").alias("o"), F.col("n").alias("t"))
    rows = perm.groupBy("pos").agg(F.count(F.lit(1)).alias("m")).join(F.broadcast(total), F.lit(True), "left")
    places = rows.agg(F.count(F.when((F.col("m") > 1) | (F.col("pos") < F.col("o")) | (F.col("pos") >= F.col("o") + F.col("t")), 1)).alias("wrong_places"))
    dofs = perm.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("dof").alias("dofs"))
    lost = perm.join(nodes.where("is_leaf").select(F.col("path").alias("leaf"), "off", "n"), "leaf", "left").agg(F.count(F.when(F.col("off").isNull() | (F.col("pos") < F.col("off")) | (F.col("pos") >= F.col("off") + F.col("n")), 1)).alias("out_of_leaf"))
    below = nodes.where("parent is not null").groupBy(F.col("parent").alias("path")).agg(F.sum("n").alias("held"), F.min(F.when(F.col("n") > 0, F.col("off"))).alias("begin"))
    torn = nodes.where("not is_leaf").join(below, "path", "left").agg(F.count(F.when(F.col("held").isNull() | (F.col("held") != F.col("n")) | (F.col("begin") != F.col("off")), 1)).alias("torn_nodes"))
    out = dofs
    for one in (places, lost, torn):  # one row each
        out = out.join(F.broadcast(one), F.lit(True))
    return out
