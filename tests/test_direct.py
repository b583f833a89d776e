"""Products without stored leaves against dense NumPy."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockwood.functions.kernels import Kernel
from blockwood.operators.blocks import Admissibility
from blockwood.operators.cluster import Clustering
from blockwood.operators.direct import kernel_product
from blockwood.sources import points as P

KERNELS = {
    "strata": Kernel("exp", 0.7, nugget=0.25, scale=2.0, strata=(Kernel("laplace", scale=0.1), Kernel("gram", scale=0.01))),
    "helmholtz": Kernel("helmholtz", wave=1.5, strata=(Kernel("exp", 1.0),)),
    "user": Kernel("user", user=lambda p, q, i, j: np.cos(p[:, :1] - q[:, 0]) + (i[:, None] == j)),
    "hints": Kernel("exp", 0.9, null_rows=lambda p, i: i % 3 == 0),
}


def points_of(spark, n, shift=0.0):
    return P.cylinder(spark, n).withColumns({c: F.transform(c, lambda v: v * 0.9 + shift) for c in ("coord", "lo", "hi")})


@pytest.mark.parametrize(("name", "task_points"), [*((n, 1_000_000) for n in KERNELS), ("strata", 140)])
def test_products_equal_dense_ones(spark, name, task_points):
    rows, cols, kernel = points_of(spark, 150), points_of(spark, 130, 0.2), KERNELS[name]
    rng = np.random.default_rng(5)
    b = rng.normal(size=(2, 130)) + (1j * rng.normal(size=(2, 130)) if name in ("helmholtz", "user") else 0)
    x = spark.createDataFrame([(j, k, float(b[k, j].real), float(b[k, j].imag)) for k in range(2) for j in range(130)], "dof long, rhs int, re double, im double")
    x = x if np.iscomplexobj(b) else x.drop("im")
    got = kernel_product(rows, kernel, x, columns=cols, clustering=Clustering(max_leaf=16), admissibility=Admissibility("standard", eta=3.0), eps=1e-10, task_points=task_points).collect()
    p, q = (np.array([r.coord for r in c.orderBy("dof").collect()]) for c in (rows, cols))
    dense = sum(k.block(p, q, np.arange(150), np.arange(130)) for k in (kernel, *kernel.strata)) @ b.T
    y = np.zeros((150, 2), complex)
    for r in got:
        y[r.dof, r.rhs] += r.re + 1j * r.im
    assert len(got) == 300 and np.abs(y - dense).max() < 1e-6 * np.abs(dense).max()


def test_near_field_stays_in_the_jvm(spark):
    from blockwood.operators.blocks import build_blocks
    from blockwood.operators.cluster import build_tree
    from blockwood.operators.direct import near_field
    from blockwood.operators.matrix import HMatrix

    cloud = points_of(spark, 60)
    nodes, perm = build_tree(cloud, Clustering(max_leaf=10))
    m = HMatrix(nodes, perm, nodes, perm, build_blocks(nodes, nodes, Admissibility()).where("kind = 'full'"), None)
    x = P.right_hand_side(cloud, 1.0).withColumn("im", F.lit(0.0))
    plan = near_field(m, Kernel("exp", 1.0), x)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "Python" not in plan


def test_points_and_vectors_are_not_broadcast(spark):
    """Tables with a row for each point meet in merge joins, although their files are far below Spark's limit for broadcasts."""
    n = 24_000
    cloud = spark.range(n).select(F.col("id").alias("dof"), F.array((F.col("id") % 3000).cast("double")).alias("coord"))
    cloud = cloud.select("dof", "coord", F.col("coord").alias("lo"), F.col("coord").alias("hi"), F.lit(None).cast("int").alias("group_id"))
    x = spark.range(n).select(F.col("id").alias("dof"), F.lit(0).alias("rhs"), F.lit(1.0).alias("re"))
    out = kernel_product(cloud, Kernel("exp", 50.0), x, clustering=Clustering("median", max_leaf=400), admissibility=Admissibility("hodlr"), eps=1e-8)
    assert out.count() == n
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    by_point = [line for line in joins if re.search(r"dof#\d+L? =|pos#\d+L? =", line)]
    assert by_point and all("strategy=merge" in line for line in by_point)
