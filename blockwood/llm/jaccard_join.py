"""Exact n-gram Jaccard join in metric space: pivots, Voronoi regions, triangle-inequality windows.

Jaccard distance d is a metric, and texts link when d <= r (r = 1 - similarity).  The search
narrows by pivots and windows that lose no link.

1. Sampled documents, far from each other, are the first pivots.  A set within ``INNER`` of one lies in the Voronoi cell
   of the nearest, and in cells of earlier pivots inside the window d(x, p) <= d(x, nearest) + 2r; all others form the outer
   cell, and those of them within INNER + r of a pivot are replicated to its cell.  Sets in a pivot's ball (d <= r) are
   linked to it at once; they stay only if a set outside the ball can reach them.
2. Pivot "empty set": in the symmetric-difference metric a set's distance to it is its
   size, and two linked sets differ by at most delta = (1/s - 1) * size elements.  Sizes form
   rings; sets inside the window of the next smaller ring are replicated to it.
3. Unrelated texts are all at distance 1 from any document, so that documents alone cannot
   split the outer cell.  Inside a ring the shingles are therefore dealt, by hash, to m > delta + 1 sub-spaces:
   two linked sets agree wholly in m - delta of them at least.  The pivots of a sub-space are all the
   restricted sets that occur, a set belongs to the Voronoi cell of the pivot at distance 0,
   and cells that share members form one region.  A set keeps the delta + 1 cells with the most
   shingles (ties by hash): the first in this order of those where two linked sets agree is kept by both.
4. In a region of more than three sets pivots are documents again: every set goes to the nearest one and, within the
   window d(x, p) <= d(x, nearest) + 2r, to cells of earlier pivots.  Members within r of their
   pivot are linked to it; others, with those ball members that the triangle inequality
   leaves in reach of them, join recursively.  Every reported link is verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import ship
from ..frames import discard, sweep
from .common import byte_batches, mixed, settle, text_buffer, word_hashes, word_spans

_SEED = np.uint64(0xD6E8FEB86659FD93)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle) pairs, sorted and distinct."""
    data, offsets = text_buffer(column)
    starts, ends, text = word_spans(data, offsets)
    h = word_hashes(data, starts, ends)
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    code = np.zeros(n, np.uint64)
    for k in range(width):
        code[: n - k] += mixed(h[k:] * _ODD[k % 4] + np.uint64(k))
    full = np.zeros(n, bool)
    full[: n - width + 1] = text[: n - width + 1] == text[width - 1 :]
    # a text of fewer words is one shingle as a whole
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    size = np.diff(np.r_[first, n])
    for at, words in zip(first[size < width], size[size < width], strict=True):
        total = np.zeros(1, np.uint64)
        for k in range(words):
            total += mixed(h[at + k : at + k + 1] * _ODD[k % 4] + np.uint64(k))
        code[at] = mixed(total ^ np.uint64(words))[0]
        full[at] = True
    code, text = code[full], text[full]
    order = np.lexsort((code, text))
    code, text = code[order], text[order]
    new = np.r_[True, (code[1:] != code[:-1]) | (text[1:] != text[:-1])]
    return text[new], code[new]


def rings(percent: int, most: int) -> np.ndarray:
    """Smallest size of each ring; partners of a ring's sets lie in it or in the next one."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(100 * edges[-1] // percent + 1)
    return np.array(edges, dtype=np.int64)


def set_keys(text: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First pair, size and key (a hash of the whole set) of each text that has shingles."""
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(text)])
    key = mixed(np.add.reduceat(mixed(code ^ _SEED), first) + size.astype(np.uint64)) if len(first) else np.zeros(0, np.uint64)
    return first, size, key


INNER = 0.5  # radius of a first pivot's cell


class Pivots:
    """First pivots: few sets, far from each other, and the distances of many sets to them."""

    def __init__(self, sets: list[np.ndarray], keys: list[int]):
        self.sets, self.keys = sets, np.array(keys, np.int64)
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        bit = np.repeat(np.uint64(1) << np.arange(len(sets), dtype=np.uint64), [len(s) for s in sets])
        self.codes, place = np.unique(every, return_inverse=True)
        self.masks = np.zeros(len(self.codes), np.uint64)
        np.bitwise_or.at(self.masks, place, bit)

    @staticmethod
    def choose(sets: list[np.ndarray], keys: list[int], percent: int, most: int = 16) -> Pivots:
        """Of sampled sets those with the most sets around them first, each more than 4r from the ones before."""
        once = sorted({k: s for k, s in zip(keys, sets, strict=True) if len(s)}.items())
        reach = 1 - percent / 100
        if not once:
            return Pivots([], [])
        size = np.array([len(s) for _, s in once])
        code, first = np.concatenate([s for _, s in once]), np.cumsum(size) - size
        apart = []
        for at in range(0, len(once), 64):
            some = Pivots([s for _, s in once[at : at + 64]], [k for k, _ in once[at : at + 64]])
            inter = some.shared(code, first, size)
            apart.append(1 - inter / (size[None, :] + size[at : at + 64][:, None] - inter))
        apart = np.concatenate(apart)
        order = np.argsort(-(apart <= 4 * reach).sum(1), kind="stable")
        out: list[int] = []
        for i in order:
            if len(out) < most and all(apart[i, j] > 4 * reach for j in out):
                out.append(int(i))
        return Pivots([once[i][1] for i in out], [once[i][0] for i in out])

    def shared(self, code: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Intersection sizes: one row per pivot, one column per set."""
        out = np.zeros((len(self.sets), len(first)), np.int64)
        if not len(self.codes) or not len(first):
            return out
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = np.flatnonzero(self.codes[at] == code)
        owner, mask = np.repeat(np.arange(len(first)), size)[hit], self.masks[at[hit]]
        for j in range(len(self.sets)):
            out[j] = np.bincount(owner[(mask >> np.uint64(j)) & np.uint64(1) == 1], minlength=len(first))
        return out

    def places(self, code: np.ndarray, first: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(set number, pivot or -1 for the outer cell, distance, whether in the pivot's ball) of every cell a set lies in."""
        n, reach = len(first), 1 - percent / 100
        outer = (np.arange(n), np.full(n, -1), np.ones(n), np.zeros(n, bool))
        if not self.sets or not n:
            return outer
        inter = self.shared(code, first, size)
        union = size[None, :] + np.array([len(s) for s in self.sets])[:, None] - inter
        d = 1 - inter / union
        home, near = np.argmin(d, axis=0), d.min(axis=0)
        inside = near <= INNER
        cell = np.arange(len(self.sets))[:, None]
        member = np.where(inside, (cell == home) | ((cell < home) & (d <= near + 2 * reach + 1e-9)), d <= INNER + reach + 1e-9)
        pivot, number = np.nonzero(member)
        ball = 100 * inter[pivot, number] >= percent * union[pivot, number]
        far = np.flatnonzero(~inside)
        join = lambda a, b: np.concatenate([a, b])
        return join(number, far), join(pivot, np.full(len(far), -1)), join(d[pivot, number], np.ones(len(far))), join(ball, np.zeros(len(far), bool))


def cells(code: np.ndarray, first: np.ndarray, size: np.ndarray, key: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, set key) of every set in its own ring and, inside the window, in the next smaller one.

    The lower ``percent``, the fewer shingles a sub-space has: more of them then leave enough to choose from, so
    that empty ones and those of one common shingle, which unrelated sets share, are not kept.
    """
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    edges = rings(percent, int(size.max()))
    home = np.searchsorted(edges, size, side="right") - 1
    out_cell, out_key = [], []
    spread = mixed(code * _ODD[1])
    for back in (0, 1):
        ring = home - back
        top = edges[np.clip(ring, 0, None) + 1] - 1  # largest size in the ring
        delta = top * (100 - percent) // percent
        take = (ring >= 0) & (delta > 0) & (size * percent <= 100 * top)
        if not take.any():
            continue
        parts = np.where(take, delta + 2 + (delta // 2 if percent < 90 else 0), 0)
        base = np.cumsum(parts) - parts
        owner = np.repeat(np.arange(len(first)), size)
        use = take[owner]
        slot = base[owner[use]] + (spread[use] % parts[owner[use]].astype(np.uint64)).astype(np.int64)
        total, count = np.zeros(int(parts.sum()), np.uint64), np.zeros(int(parts.sum()), np.int64)
        np.add.at(total, slot, mixed(code[use] * _ODD[2]))
        np.add.at(count, slot, 1)
        doc = np.repeat(np.arange(len(first)), parts)
        number = np.arange(len(doc)) - base[doc]
        cell = mixed(total ^ mixed((ring[doc] * (1 << 24) + number).astype(np.uint64)))
        order = np.lexsort(((np.minimum(count, 255).astype(np.uint64) << np.uint64(56)) | (cell >> np.uint64(8)), doc))
        keep = order[number >= (parts - delta - 1)[doc]]
        out_cell.append(cell[keep])
        out_key.append(key[doc[keep]])
    if not out_cell:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(out_cell), np.concatenate(out_key)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of every key of the links (a, b) with the smallest that it reaches: fewer links, the same components."""
    names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    low, high = place[: len(a)], place[len(a) :]
    root = np.arange(len(names))
    while len(low):
        before = root.copy()
        np.minimum.at(root, low, before[high])
        np.minimum.at(root, high, before[low])
        root = root[root]
        if (root == before).all():
            break
    moved = root != np.arange(len(names))
    return names[moved], names[root[moved]]


# ---------------------------------------------------------------- joining one region in one task


def _cell_members(table: np.ndarray, near: np.ndarray, reach: float) -> list[np.ndarray]:
    """Members of each pivot's cell that must still be compared with each other.

    ``table``: distances, one row per pivot.  A cell has its own sets and, as guests,
    those of later pivots inside the window.  Its pivot's ball is linked already; of the ball stay
    those that a set outside it can reach.
    """
    home, out = np.argmin(table, axis=0), []
    for j in range(len(table)):
        member = (home == j) | ((home > j) & (table[j] <= near + 2 * reach + 1e-9))
        inside = table[j] <= reach + 1e-9
        outside = member & ~inside
        if outside.any():
            outside |= member & inside & (table[j] >= table[j][outside].min() - reach - 1e-9)
        out.append(np.flatnonzero(outside))
    return out


class Region:
    """Sets of a region, the links found, and their classes so far."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        self.size = np.array([len(s) for s in sets], np.int64)
        self.parent = np.arange(len(sets))
        self.compared = self.by_pivot = self.by_scan = 0  # distances taken; links through pivots and within leaves
        self.scanning = False

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.by_scan += self.scanning
            self.by_pivot += not self.scanning
            self.parent[max(a, b)] = min(a, b)

    def common(self, pivot: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Size of the intersection of ``pivot`` with each set of ``rows``."""
        self.compared += len(rows)
        size = self.size[rows]
        every = np.concatenate([self.sets[i] for i in rows])
        at = np.minimum(np.searchsorted(pivot, every), len(pivot) - 1)
        return np.add.reduceat((pivot[at] == every).astype(np.int64), np.cumsum(size) - size)

    def against(self, pivot: int, rows: np.ndarray) -> np.ndarray:
        """Distances of ``rows`` to a member; links those within reach."""
        inter = self.common(self.sets[pivot], rows)
        union = self.size[rows] + self.size[pivot] - inter
        for i in rows[100 * inter >= self.percent * union]:
            self.link(int(i), pivot)
        return 1 - inter / union

    def one_class(self, rows: np.ndarray) -> bool:
        first = self.root(int(rows[0]))
        return all(self.root(int(i)) == first for i in rows[1:])

    def scan(self, rows: np.ndarray) -> None:
        """Each member against the later ones that may reach it and are not linked with it yet."""
        rows = rows[np.argsort(self.size[rows], kind="stable")]
        self.scanning = True
        for n, i in enumerate(rows[:-1]):
            later = rows[n + 1 :]
            later = later[: np.searchsorted(self.size[later] * self.percent, 100 * self.size[i], side="right")]
            mine = self.root(int(i))
            later = np.array([j for j in later if self.root(int(j)) != mine], dtype=np.int64)
            if len(later):
                self.against(int(i), later)
        self.scanning = False

    def join(self, rows: np.ndarray, leaf: int = 3, pivots: int = 6) -> None:
        while len(rows) > leaf:
            if self.one_class(rows):
                return
            reach = 1 - self.percent / 100
            near, chosen, dist = np.full(len(rows), np.inf), [], []
            nxt = 0
            for _ in range(pivots):  # the next pivot is the set farthest from those before it
                d = self.against(int(rows[nxt]), rows)
                chosen.append(nxt)
                dist.append(d)
                near = np.minimum(near, d)
                nxt = int(np.argmax(near))
                if near[nxt] == 0:
                    break
            cut = [rows[take] for take in _cell_members(np.stack(dist), near, reach)]
            if sum(map(len, cut)) > 1.5 * len(rows):  # all lie in each other's windows: pivots cannot part them
                self.scan(rows)
            else:
                for part in cut:
                    if len(part) > 1:
                        self.join(part, leaf, pivots)
            return
        if len(rows) > 1 and not self.one_class(rows):
            self.scan(rows)


def _region_classes(percent: int):
    def run(table: pa.Table) -> pa.Table:
        keys = np.asarray(table.column("key"))
        blobs = table.column("shingles").to_pylist()
        order = np.argsort(keys, kind="stable")
        order = order[np.r_[True, keys[order][1:] != keys[order][:-1]]]
        region = Region([np.frombuffer(blobs[i], np.uint64) for i in order], percent)
        region.join(np.arange(len(order)))
        roots = np.array([keys[order[region.root(i)]] for i in range(len(order))], np.int64)
        return pa.table({"key": pa.array(keys[order]), "class": pa.array(roots)})

    return run


# ---------------------------------------------------------------- classes of linked keys


def classes(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): every key that occurs with the smallest key it reaches.

    Alternates large and small stars: every key's larger, then its smaller neighbours are
    moved to the smallest one.  Rounds end when the edges no longer change.
    """
    settled = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = settled.unionByName(settled.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("k")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(least, F.col("u") == F.col("k")).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        old, settled = settled, settle(small.where("u <> v").distinct())
        discard(old)
        now = settled.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return settled.select(F.col("u").alias("key"), F.col("v").alias("class")).unionByName(settled.select(F.col("v").alias("key"), F.col("v").alias("class")).distinct())


# ---------------------------------------------------------------- the join


def _parts(rows: DataFrame, part_bytes: int) -> int:
    """A part for each ``part_bytes`` of text, at least as many as Spark would take."""
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))


def similarity_classes(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    width: int = 3,
    percent: int = 90,
    task_shingles: int = 4_000_000,
    sampled: int = 512,
    part_bytes: int = 16 << 20,
) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_shingles`` and ``component_id``, the smallest key reachable by links.

    A text's set holds its distinct ``width``-word shingles (lower-cased A-Z); a text of
    fewer words is one shingle as a whole.  Texts link when 100 * intersection >=
    ``percent`` * union.  Null and empty texts have no shingles and link with nothing: their
    component is their own key.  Copies share one set, which is compared once.  Null keys are
    never the smallest; a component of them alone is null.  Shingles and sets are known by 64-bit hashes.
    The first pivots come from ``sampled`` texts of at most 65,536 characters; which ones changes the work, not the result.

    Regions of up to ``task_shingles`` shingles are joined in one task; larger ones are
    first split over the cluster (``_split_regions``) until they fit.  Cells are dealt to a part for each ``part_bytes`` of text, so
    that a part is sorted in memory at any size.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"), F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("_row"))

    few = rows.where(F.length("_text").between(1, 65_536)).select("_text", F.xxhash64("_row", F.lit("pivot")).alias("o")).orderBy("o").limit(sampled).select("_text").toArrow()
    number, code = shingle_sets(few.column("_text"), width)
    first, size, keys = set_keys(number, code)
    pivots = Pivots.choose([code[a : a + n] for a, n in zip(first, size, strict=True)], keys.view(np.int64).tolist(), percent)
    reach = 1 - percent / 100
    kind = dict(rows.dtypes)["_id"]
    names = ["_id", "_row", "n_shingles", "key", "pivot", "distance"]
    types = [None, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]

    def sets_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
        """Sizes and keys of all texts, and the batch's sets, each once."""
        number, code = shingle_sets(batch.column("_text"), width)
        first, size, keys = set_keys(number, code)
        n, k = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        n[number[first]], k[number[first]] = size, keys.view(np.int64)
        _, once = np.unique(keys, return_index=True)
        return n, k, _some(code, first, size, keys, np.sort(once))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "_text", 2 << 20):
            def rows_of(n: int, **given) -> pa.RecordBatch:
                kinds = [batch.schema.field("_id").type, *types[1:]]  # noqa: B023
                return pa.RecordBatch.from_arrays([(pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x, t) if isinstance(x := given[c], np.ndarray) else x) if c in given else pa.nulls(n, t) for c, t in zip(names, kinds, strict=True)], names=names)

            n, k, (code, first, size, keys) = sets_of(batch)
            yield rows_of(len(n), _id=batch.column("_id"), _row=batch.column("_row"), n_shingles=n, key=k)
            whose, pivot, distance, ball = pivots.places(code, first, size, percent)
            for j in np.unique(pivot[pivot >= 0]):
                here = pivot == j
                linked = here & ball
                yield rows_of(int(linked.sum()), key=keys[whose[linked]], _row=np.full(linked.sum(), pivots.keys[j]), pivot=np.full(linked.sum(), j, np.int32))
                if (here & ~ball).any():  # the nearest set outside the ball
                    yield rows_of(1, pivot=np.array([j], np.int32), distance=distance[here & ~ball].min(keepdims=True))

    found = settle(rows.mapInArrow(scan, f"_id {kind}, _row long, n_shingles long, key long, pivot int, distance double"))
    meta = found.where("n_shingles is not null")
    # a row for each pivot
    rims = {r["pivot"]: r["rim"] for r in found.where("distance is not null").groupBy("pivot").agg(F.min("distance").alias("rim")).collect()}
    balls = found.where("n_shingles is null and key is not null").select(F.col("key").alias("a"), F.col("_row").alias("b"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "_text", 2 << 20):
            _, _, (code, first, size, keys) = sets_of(batch)
            whose, pivot, distance, ball = pivots.places(code, first, size, percent)
            spots = []
            for j in np.unique(pivot):
                # of a ball stay those that a set outside it can reach
                take = np.flatnonzero((pivot == j) & ~(ball & (distance < rims.get(int(j), 3.0) - reach - 1e-9)))
                cell, mine = cells(*_some(code, first, size, keys, np.sort(whose[take])), percent)
                spots.append((mixed(cell ^ mixed(np.full(1, j + 1, np.uint64))) if j >= 0 else cell, mine))
            if not spots:
                continue
            cell, mine = (np.concatenate(x) for x in zip(*spots, strict=True))
            # of each cell its smallest key leaves the batch; the links of the others to it are cells of two
            order = np.lexsort((mine, cell))
            cell, mine = cell[order], mine[order]
            head = np.r_[True, cell[1:] != cell[:-1]][: len(cell)]
            least = mine[head][np.cumsum(head) - 1]
            apart = least != mine
            a, b = forest(mine[apart], least[apart])
            pair = mixed(mixed(a ^ _SEED) + b * _ODD[3])
            cell, mine = np.concatenate([cell[head], pair, pair]), np.concatenate([mine[head], a, b])
            yield pa.RecordBatch.from_arrays([pa.array(mine.view(np.int64)), pa.array(cell.view(np.int64))], names=["key", "cell"])

    # the cells, 16 bytes to every second to fifth shingle, are dealt as they are found and never written as a table
    met = rows.select("_text").mapInArrow(deal, "key long, cell long").repartition(_parts(rows, part_bytes), "cell")
    least = met.withColumn("least", F.min("key").over(Window.partitionBy("cell")))  # a cell has one key for each batch at most
    links = least.where("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b"))
    regions = classes(links).withColumnRenamed("class", "region")
    sweep(docs.sparkSession)

    # one row of docs stands for each set of a region
    chosen = meta.where("n_shingles > 0").groupBy("key").agg(F.min("_row").alias("_row")).join(regions, "key").select("key", "region", F.col("_row").alias("_chosen"))
    texts = rows.join(chosen, F.col("_row") == F.col("_chosen")).select("key", "region", "_text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "_text", 2 << 20):
            number, code = shingle_sets(batch.column("_text"), width)
            first, size, keys = set_keys(number, code)
            # a row that only shares its row hash with the chosen one is not its set
            right = keys.view(np.int64) == np.asarray(batch.column("key"))[number[first]]
            blobs = [code[a : a + n].tobytes() for a, n in zip(first[right], size[right], strict=True)]
            at = pa.array(number[first][right])
            yield pa.RecordBatch.from_arrays([batch.column("key").take(at), batch.column("region").take(at), pa.array(blobs, pa.binary())], names=["key", "region", "shingles"])

    sets = sets_here = settle(texts.mapInArrow(build, "key long, region long, shingles binary"))
    sweep(docs.sparkSession)
    weight = sets.groupBy("region").agg((F.sum(F.length("shingles")) / 8).cast("long").alias("weight"), F.count(F.lit(1)).alias("members"))
    sets = sets.join(weight, "region")
    joined = sets.where(F.col("weight") <= task_shingles).groupBy("region").applyInArrow(_region_classes(percent), "key long, class long")
    large = sets.where(F.col("weight") > task_shingles)
    if large.limit(1).count():
        joined = joined.unionByName(_split_regions(large.select("region", "key", "shingles"), percent, task_shingles))
    found_classes = settle(joined.distinct())
    found_classes, labels = _with_balls(found_classes, balls, pivots)
    discard(sets_here)
    sweep(docs.sparkSession)

    # smallest document of each class, then of each set; classes are small beside documents
    by_key = meta.where("n_shingles > 0").groupBy("key").agg(F.min("_id").alias("least")).join(found_classes, "key", "left").withColumn("class", F.coalesce("class", "key"))
    by_class = by_key.groupBy("class").agg(F.min("least").alias("component_id"))
    # the classes of balls, which may hold a third of all sets, are few: their sets stay where they are
    large = F.col("class").isin(labels)
    named = by_key.where(~large).join(by_class.where(~large), "class").unionByName(by_key.where(large).join(F.broadcast(by_class.where(large)), "class")).select(F.col("key").alias("_set"), "component_id")
    out = meta.where("n_shingles > 0").join(named, F.col("key") == F.col("_set")).select("_id", "n_shingles", "component_id")
    out = out.unionByName(meta.where("n_shingles = 0").select("_id", "n_shingles", F.col("_id").alias("component_id")))
    return out.select(F.col("_id").alias(key), "n_shingles", "component_id")


def _with_balls(found: DataFrame, balls: DataFrame, pivots: Pivots) -> tuple[DataFrame, list[int]]:
    """Classes (key, class) after the links (a, b) of ball members with pivots, and the at most 16 names of classes that hold a pivot.

    A class is joined to every pivot that one of its sets is linked to; pivots that meet in a class are one.  Only
    pairs of pivots reach the driver, and no ball is ever gathered under one key.
    """
    members = balls.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("near"))
    named = settle(found.join(members, F.col("key") == F.col("a"), "full_outer").select(F.coalesce("key", "a").alias("key"), F.coalesce("class", "key", "a").alias("class"), "near"))
    met = named.where("near is not null").groupBy("class").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("near")))).alias("near"))
    met = settle(met)
    name = {int(k): int(k) for k in pivots.keys}
    for r in met.select(F.explode("near").alias("b"), F.col("near")[0].alias("a")).where("a <> b").distinct().collect():  # at most 16 * 15 / 2 pairs
        low, high = sorted((name[r["a"]], name[r["b"]]))
        name = {k: low if v == high else v for k, v in name.items()}
    if not name:
        return named.select("key", "class"), []
    label = F.create_map(*[F.lit(x).cast("long") for pair in name.items() for x in pair])
    linked = named.where("near is not null").select("key", label[F.col("near")[0]].alias("class"))
    others = named.where("near is null").select("key", "class").join(met.select("class", label[F.col("near")[0]].alias("label")), "class", "left")
    return linked.unionByName(others.select("key", F.coalesce("label", "class").alias("class"))), sorted(set(name.values()))


def _some(code: np.ndarray, first: np.ndarray, size: np.ndarray, key: np.ndarray, which: np.ndarray):
    """The sets ``which`` alone."""
    take = np.zeros(len(first), bool)
    take[which] = True
    size_ = size[which]
    return code[np.repeat(take, size)], np.cumsum(size_) - size_, size_, key[which]


def _split_regions(sets: DataFrame, percent: int, task_shingles: int, most_rounds: int = 8) -> DataFrame:
    """Classes (key, class) of regions too large for one task, by rounds over the cluster.

    A round draws about eight pivots in each region by hash, measures every set against
    them in chunks, links it with those in reach and sends it to its Voronoi cell and, within
    the window, to cells of earlier pivots; ball members leave.  Cells whose members are
    all of one class leave as well.  Regions that fit a task are joined there.  Where all
    members lie in each other's windows, or rounds run out, the region is compared chunk against
    chunk, each pair of chunks in a task of its own.
    """
    reach = 1 - percent / 100
    links, small = [], []
    for turn in range(most_rounds + 1):
        info = sets.groupBy("region").agg(F.count(F.lit(1)).alias("members"), F.sum(F.length("shingles") / 8).alias("weight"), F.min("key").alias("first"))
        sets = settle(sets.join(info, "region"))
        small.append(sets.where(F.col("weight") <= task_shingles).select("region", "key", "shingles"))
        sets = sets.where(F.col("weight") > task_shingles)
        if not sets.limit(1).count():
            break
        chunks = F.ceil(F.col("weight") * 4 / task_shingles).cast("int")
        sets = sets.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("key", F.lit(turn)), F.col("chunks")).cast("int"))
        drawn = (F.col("key") == F.col("first")) | (F.pmod(F.xxhash64("key", F.lit(turn), F.lit("pivot")), F.greatest(F.lit(1), (F.col("members") / 8).cast("long"))) == 0)
        pivots = sets.where(drawn).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        both = sets.withColumn("pivot", F.lit(False)).unionByName(pivots.withColumn("pivot", F.lit(True))).select("region", "chunk", "key", "shingles", "pivot")
        out = settle(both.groupBy("region", "chunk").applyInArrow(_measured(percent), "region long, cell long, key long, d double, member boolean"))
        links.append(out.where(~F.col("member")).select(F.col("key").alias("a"), F.col("cell").alias("b")))
        cells_ = out.where("member")
        rim = cells_.where(F.col("d") > reach + 1e-9).groupBy("region", "cell").agg(F.min("d").alias("rim"))
        cells_ = cells_.join(rim, ["region", "cell"]).where(F.col("d") >= F.col("rim") - reach - 1e-9)
        # a region whose cells grow beyond it is scanned
        grown = cells_.groupBy("region").agg(F.count(F.lit(1)).alias("moved")).join(info, "region")
        grown = settle(grown.select("region", ((F.col("moved") > 1.5 * F.col("members")) | F.lit(turn == most_rounds)).alias("stuck")))
        stuck = sets.join(grown.where("stuck").select("region"), "region", "left_semi")
        pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(c, F.col("chunk")).alias("i"), F.greatest(c, F.col("chunk")).alias("j"))))
        spread = stuck.withColumn("pair", pair).select("region", "pair.i", "pair.j", "key", "shingles")
        links.append(settle(spread.groupBy("region", "i", "j").applyInArrow(_region_classes(percent), "key long, class long").where("key <> class").select(F.col("key").alias("a"), F.col("class").alias("b"))))
        moved = cells_.join(grown.where("not stuck").select("region"), "region", "left_semi").select("region", "cell", "key")
        linked = classes(_union(links))
        moved = moved.join(linked, "key", "left").withColumn("class", F.coalesce("class", "key"))
        alive = moved.groupBy("region", "cell").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("region", "cell")
        moved = moved.join(alive, ["region", "cell"], "left_semi").select("region", "cell", "key")
        sets = moved.join(sets.select("region", "key", "shingles"), ["region", "key"]).select(F.xxhash64("region", "cell", F.lit(turn)).alias("region"), "key", "shingles")
    for part in small:
        links.append(part.groupBy("region").applyInArrow(_region_classes(percent), "key long, class long").select(F.col("key").alias("a"), F.col("class").alias("b")))
    return classes(_union(links))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _measured(percent: int):
    """Links of a chunk's sets with pivots (member false), and the cells they belong to."""
    reach = 1 - percent / 100

    def run(table: pa.Table) -> pa.Table:
        is_pivot = np.asarray(table.column("pivot"))
        keys, blobs = np.asarray(table.column("key")), table.column("shingles").to_pylist()
        area = table.column("region")[0].as_py()
        rows, marks = np.flatnonzero(~is_pivot), np.flatnonzero(is_pivot)
        marks = marks[np.argsort(keys[marks])]
        parts = []
        if len(rows):
            region = Region([np.frombuffer(b, np.uint64) for b in blobs], percent)
            dist = []
            for p in marks:
                inter = region.common(region.sets[p], rows)
                union = region.size[rows] + region.size[p] - inter
                dist.append(1 - inter / union)
                linked = rows[(100 * inter >= percent * union) & (keys[rows] != keys[p])]
                parts.append((np.full(len(linked), keys[p]), keys[linked], np.zeros(len(linked)), np.zeros(len(linked), bool)))
            table_ = np.stack(dist)
            home, near = np.argmin(table_, axis=0), table_.min(axis=0)
            for j, p in enumerate(marks):
                i = np.flatnonzero((home == j) | ((home > j) & (table_[j] <= near + 2 * reach + 1e-9)))
                parts.append((np.full(len(i), keys[p]), keys[rows[i]], table_[j, i], np.ones(len(i), bool)))
        cell, key, d, member = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))
        return pa.table({"region": pa.array(np.full(len(cell), area, np.int64)), "cell": pa.array(cell), "key": pa.array(key), "d": pa.array(d), "member": pa.array(member)})

    return run
