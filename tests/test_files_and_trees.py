"""Array and text files, hints of zero rows, walks and changes of trees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockwood.functions.kernels import Kernel
from blockwood.operators import trees as T
from blockwood.operators.blocks import Admissibility
from blockwood.operators.cluster import Clustering, build_tree
from blockwood.operators.matrix import HMatrix
from blockwood.sources import points as P
from blockwood.sources import storage
from blockwood.sources.arrays import TYPES, read_array, write_array


def test_lines_are_numbered_over_splits_and_files(spark, tmp_path):
    for name, first in (("a.txt", 0), ("b.txt", 3000)):
        (tmp_path / name).write_text("".join(f"{first + i} {'9' * (i % 40 + 1)}\n" + "\n" * (i % 7 == 0) for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = P.read_text(spark, str(tmp_path)).select("dof", F.col("coord")[0].alias("x")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 6000 and all(r.dof == r.x for r in rows)


@pytest.mark.parametrize("scalar", list(TYPES))
def test_array_files(spark, tmp_path, scalar):
    rng = np.random.default_rng(3)
    full = rng.integers(-9, 9, (7, 3)) + (1j * rng.integers(-9, 9, (7, 3)) if scalar in "CZ" else 0)
    full[:, 1] = 0  # a column without any place
    table = spark.createDataFrame([(i, j, float(np.real(full[i, j])), float(np.imag(full[i, j]))) for i in range(7) for j in range(3) if full[i, j]], "row long, col long, re double, im double")
    write_array(table, str(tmp_path / "x"), 7, 3, scalar)
    data = (tmp_path / "x").read_bytes()
    assert np.frombuffer(data[:20], "<i4").tolist() == [TYPES[scalar][0], 7, 3, TYPES[scalar][1].itemsize, 0]
    assert (np.frombuffer(data[20:], TYPES[scalar][1]).reshape(3, 7).T == full).all()
    back = np.zeros((7, 3), complex)
    for r in read_array(spark, str(tmp_path / "x")).collect():
        back[r.row, r.col] = r.re + 1j * r.im
    assert (back == full).all()


def test_array_file_errors(spark, tmp_path):
    one = spark.createDataFrame([(5, 0, 1.0)], "row long, col long, re double")
    with pytest.raises(ValueError):
        write_array(one, str(tmp_path / "x"), 5, 1)
    with pytest.raises(Exception, match="occurs twice"):
        write_array(one.unionByName(one), str(tmp_path / "x"), 6, 1)
    write_array(one.limit(0), str(tmp_path / "none"), 2, 2)
    assert read_array(spark, str(tmp_path / "none")).agg(F.count("*"), F.sum("re")).first()[:] == (4, 0.0)
    (tmp_path / "short").write_bytes(b"12345")
    with pytest.raises(Exception, match="not an array file"):
        read_array(spark, str(tmp_path / "short")).count()


@pytest.mark.parametrize("method", ["svd", "aca_partial", "rrqr"])
def test_hints_of_zero_rows_and_columns(spark, method):
    cloud = P.cylinder(spark, 80)
    seen = lambda at, ids: ids % 3 == 0
    m = HMatrix.build(cloud, Kernel("exp", 1.0, null_rows=seen, null_cols=lambda at, ids: ids > 60), clustering=Clustering(max_leaf=10), admissibility=Admissibility("hodlr"), method=method, eps=1e-10)
    xyz = np.array([r.coord for r in cloud.orderBy("dof").collect()])
    want = np.exp(-np.linalg.norm(xyz[:, None] - xyz, axis=2))
    want[::3] = 0
    want[:, 61:] = 0
    got = np.zeros((80, 80))
    for r in m.values().collect():
        got[r.row_dof, r.col_dof] = r.re
    assert np.allclose(got, want, atol=1e-7)
    assert (got[::3] == 0).all() and (got[:, 61:] == 0).all()


def test_wrong_hints_are_found():
    p, ids = np.zeros((4, 1)), np.arange(4)
    hint = lambda at, ids: ids == 2
    with pytest.raises(ValueError):
        Kernel("exp", 1.0, null_rows=hint, check_nulls=True).block(p, p, ids, ids)
    zero = Kernel("user", user=lambda p, q, r, c: np.where(r[:, None] == 2, 0.0, np.ones((len(r), len(c)))), null_rows=hint, check_nulls=True)
    assert zero.block(p, p, ids, ids)[2].sum() == 0


@pytest.mark.parametrize("divider", [2, 3])
def test_walks(spark, divider):
    nodes, _ = build_tree(P.cylinder(spark, 100), Clustering("median", divider=divider, max_leaf=7))
    kids: dict = {}
    for r in nodes.collect():
        kids.setdefault(r.parent, []).append(r.path)

    def visit(path, order):
        below = sorted(kids.get(path, []))
        parts = [visit(k, order) for k in below]
        if order == "leaf":
            return sum(parts, []) if below else [path]
        cut = {"pre": 0, "in": 1, "post": len(parts)}[order]
        return sum(parts[:cut], []) + [path] + sum(parts[cut:], [])

    for order in ("pre", "in", "post", "leaf"):
        found = {r.step: r.path for r in T.walk(nodes, order).collect()}
        assert [found[i] for i in range(len(found))] == visit("r", order)


def test_tree_parts_and_moved_dofs(spark):
    nodes, perm = build_tree(P.cylinder(spark, 64), Clustering("median", max_leaf=8))
    some, places = T.subtree(nodes, perm, "r1")
    assert some.agg(F.max("n")).first()[0] == places.count() == 32
    assert T.children(nodes, "r").count() == 2 and T.subtree(nodes, perm, "x")[0].count() == 0
    sound = T.check(nodes, perm).first()
    assert sound.n == sound.dofs == 64 and not (sound.wrong_places or sound.out_of_leaf or sound.torn_nodes)
    dof = {r.pos: r.dof for r in perm.collect()}
    new, order = T.move_dof(nodes, perm, "r000", 2)
    after = {r.pos: (r.dof, r.leaf) for r in order.collect()}
    assert after[7] == (dof[2], "r001") and after[2] == (dof[7], "r000")
    assert {r.path: (r.off, r.n) for r in new.where("path in ('r000', 'r001')").collect()} == {"r000": (0, 7), "r001": (7, 9)}
    whole = T.check(new, order).first()
    assert whole.n == whole.dofs == 64 and not (whole.wrong_places or whole.out_of_leaf or whole.torn_nodes)
    for path, pos in (("r000", 8), ("r00", 0), ("r001", 8)):
        with pytest.raises(ValueError):
            T.move_dof(nodes, perm, path, pos)
    bad = T.check(nodes, perm.withColumn("pos", F.when(F.col("pos") == 0, 63).otherwise(F.col("pos")))).first()
    assert bad.wrong_places == 1 and bad.out_of_leaf == 1


def test_dump(spark, tmp_path):
    m = HMatrix.build(P.cylinder(spark, 40), Kernel("exp", 1.0), clustering=Clustering(max_leaf=10), admissibility=Admissibility("hodlr"))
    storage.dump(m, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m/blocks")).count() == m.blocks.count()
    assert spark.read.json(str(tmp_path / "m/rows/clusters")).agg(F.max("n")).first()[0] == 40
    assert sorted(r.dof for r in spark.read.json(str(tmp_path / "m/columns/points")).collect()) == list(range(40))
