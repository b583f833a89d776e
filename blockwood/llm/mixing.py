"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rank_buckets, rank_within


def pfair_period(weights: list[int]) -> list[list[int]]:
    """Slots of each source's blocks in one period of ``sum(weights)`` slots.

    Block j (from 0) of a source with share w is released at floor(j / w) and due by
    ceil((j+1) / w); each slot takes the released block with the earliest deadline (ties:
    the first source).  As the shares sum to 1 every deadline is met, so after any number
    t of slots a source has had less than one block more or fewer than w * t; after a period it
    has had exactly its weight.  Two heaps: blocks by release, and released ones by deadline.
    """
    total = sum(weights)
    slots: list[list[int]] = [[] for _ in weights]
    coming, ready = [(0, i) for i in range(len(weights))], []
    for t in range(total):
        while coming and coming[0][0] <= t:
            i = heapq.heappop(coming)[1]
            heapq.heappush(ready, (-(-(len(slots[i]) + 1) * total // weights[i]), i))
        deadline, i = heapq.heappop(ready)
        assert t < deadline
        slots[i].append(t)
        if len(slots[i]) < weights[i]:
            heapq.heappush(coming, (len(slots[i]) * total // weights[i], i))
    return slots


def turns(blocks: list[int], weights: list[int], period: list[list[int]]) -> list[int]:
    """Blocks each source has in the shortest schedule that reads every source in full."""
    size = sum(weights)
    length = max(((n - 1) // w * size + s[(n - 1) % w] + 1 for n, w, s in zip(blocks, weights, period, strict=True) if n), default=0)
    whole, part = divmod(length, size) if size else (0, 0)
    return [whole * w + sum(t < part for t in s) for w, s in zip(weights, period, strict=True)]


def mix(
    docs: DataFrame,
    weights: dict[str, int],
    *,
    default_weight: int = 1,
    block_rows: int = 64,
    most_slots: int = 4_000_000,
    key: str = "doc_id",
    source: str = "source",
    ties: list[str] | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """Interleaves the sources block by block: ``key``, ``source``, ``slot``, ``epoch``, ``block``, ``place`` and ``carry``.

    A source's rows, in an order fixed by hash, form blocks of ``block_rows`` rows (the last may be
    shorter).  ``slot`` is the block's turn, ``place`` the row's place in its block.
    Target shares are weight / sum of the weights of the sources that occur; after any number of
    slots a source has had less than one block more or fewer than its share.  Sources short of their share are read
    again (``epoch`` counts from 0) as often as it needs; the schedule ends once every source has
    been read in full, so no row is left out and the shares hold over the whole schedule.

    Weights are positive integers (else an error).  Null sources are a source of their own with the default weight.
    Repeated rows are rows like any other.  An empty table gives none.  ``carry`` columns that are
    called like a result come as ``carried_<name>``.

    One period of the schedule serves all of it: block n of a source with weight w has slot
    (n div w) * period + slot of block (n mod w).  The driver gets one count per source and
    plans ``sum(weights)`` slots (by common divisor), at most ``most_slots`` (else an error): that bounds what is broadcast.
    """
    carry = carry or []
    ties = ties or [key, source]
    named = {f"_c{i}": c for i, c in enumerate(dict.fromkeys([key, *ties, *carry]))}
    back = {c: n for n, c in named.items()}
    rows = docs.select(F.col(source).alias("_source"), *[F.col(c).alias(n) for n, c in named.items()])
    counts = sorted(((r["_source"], r["n"]) for r in rows.groupBy("_source").agg(F.count(F.lit(1)).alias("n")).limit(most_slots + 1).collect()), key=lambda x: (x[0] is not None, str(x[0])))
    shares = [weights.get(s, default_weight) for s, _ in counts]
    if any(w <= 0 or w != int(w) for w in shares):
        raise ValueError("weights are positive integers")
    shared = math.gcd(*shares) or 1
    shares = [w // shared for w in shares]
    size = sum(shares)
    if size > most_slots:
        raise ValueError(f"a period of {size} slots; at most {most_slots} are planned")
    period = pfair_period(shares)
    blocks = [-(-n // block_rows) for _, n in counts]
    table = [(c[0], w, b, n, s) for c, w, b, n, s in zip(counts, shares, blocks, turns(blocks, shares, period), period, strict=True)]
    plan = docs.sparkSession.createDataFrame(table, f"p_source {dict(rows.dtypes)['_source']}, p_weight long, p_blocks long, p_turns long, p_slots array<int>")
    ranked = rank_within(rows, "_source", [back[c] for c in ties], "_rank", buckets=rank_buckets(sum(n for _, n in counts)))
    ranked = ranked.withColumn("_block", F.expr(f"_rank div {block_rows}L"))
    met = ranked.join(F.broadcast(plan), F.col("_source").eqNullSafe(F.col("p_source")))  # most_slots numbers at most
    met = _repeated(met, max((t // b for (_, _, b, t, _) in table if b), default=0))
    turn = F.col("_block") + F.col("_epoch") * F.col("p_blocks")
    slot = F.floor(turn / F.col("p_weight")) * F.lit(size) + F.get("p_slots", F.pmod(turn, F.col("p_weight")).cast("int"))
    results = {key, source, "slot", "epoch", "block", "place"}
    return met.select(
        F.col(back[key]).alias(key),
        F.col("_source").alias(source),
        slot.cast("long").alias("slot"),
        F.col("_epoch").cast("int").alias("epoch"),
        F.col("_block").alias("block"),
        F.pmod(F.col("_rank"), F.lit(block_rows)).cast("int").alias("place"),
        *[F.col(back[c]).alias(f"carried_{c}" if c in results else c) for c in carry if c not in (key, source)],
    )


def _repeated(rows: DataFrame, most: int, at_once: int = 4096) -> DataFrame:
    """Each row once for every epoch of its source (``_epoch``).

    Rows of small sources may come again very often: beyond ``at_once`` epochs they are multiplied in two
    steps, dealt over the cluster between them, so that no task and no array holds more than ``at_once`` copies of a row.
    """
    last = F.expr("(p_turns - 1 - _block) div p_blocks")
    if most <= at_once:
        return rows.withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    often = F.expr("p_turns div p_blocks") > at_once
    few = rows.where(~often).withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    many = rows.where(often).withColumns({"_last": last, "_chunk": F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / at_once)))})
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number: few bytes here, many rows after
    many = many.repartition(parts, "_source", "_rank", "_chunk")
    inside = F.sequence(F.col("_chunk") * at_once, F.least(F.col("_last"), (F.col("_chunk") + 1) * at_once - 1))
    return few.unionByName(many.withColumn("_epoch", F.explode(inside)).drop("_last", "_chunk"))


def share_bound(period: list[list[int]], weights: list[int]) -> Fraction:
    """Largest deviation of any source from its share over one period, in blocks (below 1)."""
    total, worst = sum(weights), Fraction(0)
    for slots, w in zip(period, weights, strict=True):
        for t in range(total + 1):
            worst = max(worst, abs(sum(s < t for s in slots) - Fraction(w * t, total)))
    return worst
