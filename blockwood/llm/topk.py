"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import ship
from ..frames import discard
from .common import settle

_BLOCK = "block long, dims int, ids binary, rows binary"


def _blocks(vectors: DataFrame, size: int, kind: type) -> DataFrame:
    """Blocks of at most ``size`` vectors of one length: ids as int64, components as ``kind``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = np.asarray(batch.column("id"), dtype=np.int64)
            lists = batch.column("vector")
            lengths = np.asarray(lists.value_lengths(), dtype=np.int64)
            flat = np.asarray(lists.flatten(), dtype=np.float64)
            ends = np.cumsum(lengths)
            for dims in np.unique(lengths):
                mine = np.flatnonzero(lengths == dims)
                for at in range(0, len(mine), size):
                    take = mine[at : at + size]
                    rows = flat[(ends[take] - dims)[:, None] + np.arange(dims)]
                    # a task writes fewer than 2**32 blocks
                    yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + made], pa.int64()), pa.array([int(dims)], pa.int32()), pa.array([ids[take].tobytes()]), pa.array([np.ascontiguousarray(rows, kind).tobytes()])], names=["block", "dims", "ids", "rows"])
                    made += 1

    return vectors.mapInArrow(build, _BLOCK)


def _kind(bound: float) -> type:
    """Floats in which inner products are exact: ``bound`` limits their modulus and that of every partial sum."""
    return np.float32 if bound < 1 << 24 else np.float64


def top_k(
    vectors: DataFrame,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 5,
    every: int = 50,
    scale: int = 256,
    bins: int = 512,
    block: int = 1024,
) -> DataFrame:
    """The ``k`` best candidates of each query: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Components x become floor(scale * x).  Queries are the rows whose key divides by
    ``every``; candidates are all rows of another key and the same number of components.
    All pairs are scored in every round, on a grid: query blocks and candidate blocks are dealt to groups,
    and a cell of the grid holds the up to 16 query blocks of a group and streams the candidate blocks of the other.
    A round sums, for each query,
    a histogram of its scores over the interval that still holds the k-th value, and
    narrows the interval to one of ``bins`` parts; when it is a single value, scores of at
    least that value are kept and ties go to the smaller key.  A block reports its bins
    from the top only until they hold k scores, as lower ones cannot matter.

    Vectors that are null or hold null or non-finite components, and rows with a null key,
    take no part; squared lengths of 2**53 or more are refused, as scores would not be exact.  A key that occurs several times is searched once for each of its
    distinct vectors and is a candidate once for each row.  With fewer than k candidates all are returned.
    """
    ship(vectors.sparkSession)
    x = F.col("_vector")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("_vector"))
    rows = rows.where(F.col("id").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    rows = rows.select("id", F.transform(x, lambda v: F.floor(v * scale).cast("double")).alias("vector"))
    bound = rows.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v))).first()[0] or 0.0
    limit = int(bound) + 1  # Cauchy-Schwarz: no score is beyond the largest squared length
    if limit >= 1 << 53:
        raise ValueError("components are too large for exact integer scores")
    kind = _kind(bound)
    candidates = settle(_blocks(rows, block, kind))
    asked = rows.where(F.pmod(F.col("id"), F.lit(every)) == 0).distinct()
    queries = settle(_blocks(asked, block, kind))
    n_candidates, n_queries = candidates.count(), queries.count()
    q_groups = max(1, -(-n_queries // 16))
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c_groups = max(1, min(n_candidates, max(-(-n_candidates // 64), -(-tasks // q_groups))))
    edges = F.lit(None).cast("binary")
    state = queries.select("block", "dims", "ids", "rows", edges.alias("lows"), edges.alias("wants"))

    def grid(state: DataFrame, each, schema: str) -> DataFrame:
        """``each(query block, candidate block)`` on the cells of the grid, each of which is a run of rows: queries first."""
        group = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
        every_ = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        q = state.select("dims", group(q_groups).alias("q"), every_(c_groups).alias("c"), F.lit(0).alias("side"), "block", "ids", "rows", "lows", "wants")
        c = candidates.select("dims", every_(q_groups).alias("q"), group(c_groups).alias("c"), F.lit(1).alias("side"), "block", "ids", "rows", edges.alias("lows"), edges.alias("wants"))
        cell = ["dims", "q", "c"]
        dealt = q.unionByName(c).repartition(*cell).sortWithinPartitions(*cell, "side", "block")
        return dealt.mapInArrow(lambda batches: _cells(batches, each, kind), schema)

    width = 2 * limit + 1
    while True:
        step = -(-width // bins)
        found = grid(state, _histograms(k, width, step, -limit), "block long, row int, bin int, n long")
        total = found.groupBy("block", "row", "bin").agg(F.sum("n").alias("n"))
        above = Window.partitionBy("block", "row").orderBy(F.desc("bin"))
        total = total.withColumn("upto", F.sum("n").over(above.rowsBetween(Window.unboundedPreceding, 0)))
        # fewer than k bins and the k-th one: at most k rows for each query
        parts = total.groupBy("block").agg(F.collect_list(F.struct("row", "bin", "n", "upto")).alias("parts"))
        old, state = state, settle(state.join(parts, "block", "left").mapInPandas(_narrowed(k, step, -limit), "block long, dims int, ids binary, rows binary, lows binary, wants binary"))
        discard(old)
        if step == 1:
            break
        width = step
    best = grid(state, _selected(k), "query_id long, block long, row int, vec_id long, score long")
    order = Window.partitionBy("block", "row").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _cells(batches: Iterator[pa.RecordBatch], each, kind: type) -> Iterator[pa.RecordBatch]:
    """Holds the query blocks of a cell while its candidate blocks pass; 256 queries at a time bound the score matrix."""
    cell, held = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            x = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
            if (x["dims"], x["q"], x["c"]) != cell:
                cell, held = (x["dims"], x["q"], x["c"]), []
            ids = np.frombuffer(x["ids"], np.int64)
            rows = np.frombuffer(x["rows"], kind).reshape(len(ids), x["dims"])
            if x["side"] == 0:
                bounds = [None if x[n] is None else np.frombuffer(x[n], np.int64) for n in ("lows", "wants")]
                for at in range(0, len(ids), 256):
                    held.append((x["block"], at, ids[at : at + 256], rows[at : at + 256], *[None if v is None else v[at : at + 256] for v in bounds]))
                continue
            for block, at, q_ids, q, lows, wants in held:
                scores = (q @ rows.T).astype(np.int64)
                yield each(block, at, q_ids, lows, wants, ids, scores)


def _histograms(k: int, width: int, step: int, least: int):
    bins = -(-width // step)

    def each(block, at, q_ids, lows, wants, c_ids, scores) -> pa.RecordBatch:
        low = np.full(len(q_ids), least) if lows is None else lows
        inside = scores - low[:, None]
        where = np.where((inside >= 0) & (inside < width), inside // step, -1)  # above the interval: counted in an earlier round
        where[q_ids[:, None] == c_ids[None, :]] = -1
        hist = np.bincount(((np.arange(len(q_ids)) * (bins + 1))[:, None] + where + 1).ravel(), minlength=len(q_ids) * (bins + 1)).reshape(len(q_ids), bins + 1)[:, 1:]
        upto = np.cumsum(hist[:, ::-1], axis=1)[:, ::-1]
        row, bin_ = np.nonzero((hist > 0) & (upto - hist < (k if wants is None else wants[:, None])))
        n = len(row)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array((row + at).astype(np.int32)), pa.array(bin_.astype(np.int32)), pa.array(hist[row, bin_].astype(np.int64))], names=["block", "row", "bin", "n"])

    return each


def _narrowed(k: int, step: int, least: int):
    """Moves each query's lower edge to the bin of its k-th score; ``wants``: how many scores are still looked for from there."""

    def run(frames):
        for frame in frames:
            lows_out, wants_out = [], []
            for x in frame.itertuples():
                n = len(x.ids) // 8
                low = np.full(n, least, np.int64) if x.lows is None else np.frombuffer(x.lows, np.int64).copy()
                want = np.full(n, k, np.int64) if x.wants is None else np.frombuffer(x.wants, np.int64).copy()
                goal, moved = want.copy(), np.zeros(n, bool)
                for p in sorted(x.parts if x.parts is not None else [], key=lambda p: (p["row"], -p["bin"])):
                    r = p["row"]
                    if not moved[r] and p["upto"] >= goal[r]:
                        low[r] += p["bin"] * step
                        want[r] = goal[r] - (p["upto"] - p["n"])
                        moved[r] = True
                lows_out.append(low.tobytes())
                wants_out.append(want.tobytes())
            yield frame.drop(columns="parts").assign(lows=lows_out, wants=wants_out)

    return run


def _selected(k: int):
    """Scores at or above the k-th value; of each block the k first, as more cannot be among the k best."""

    def each(block, at, q_ids, lows, wants, c_ids, scores) -> pa.RecordBatch:
        row, col = np.nonzero((scores >= lows[:, None]) & (q_ids[:, None] != c_ids[None, :]))
        value, ids = scores[row, col], c_ids[col]
        order = np.lexsort((ids, -value, row))
        row, value, ids = row[order], value[order], ids[order]
        few = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
        row, value, ids = row[few], value[few], ids[few]
        return pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(np.full(len(row), block)), pa.array((row + at).astype(np.int32)), pa.array(ids), pa.array(value)], names=["query_id", "block", "row", "vec_id", "score"])

    return each
