"""Helpers shared by the training-data operators.

Words everywhere are maximal runs of characters other than ASCII white space
(``[^\\x20\\x09-\\x0D]+``); lower-casing maps A-Z only.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..frames import settle, shared_dir  # noqa: F401  (used by the operators)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = "\t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def by_group(df: DataFrame, group: str, columns: list[str], each, schema: str, columns_out: list[pa.DataType], names: list[str] | None = None) -> DataFrame:
    """``each(lists of the columns of one group) -> rows`` over all groups, many groups to an Arrow batch.

    Rows of a group are neighbours after one shuffle and sort, so small groups cost no
    call into Arrow of their own; only one group is held at a time.  ``names``: those of a schema with commas inside its types.
    """
    names = names or [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in columns]
        current, out = None, []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[] for _ in names]
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, columns_out, strict=True)], names=names)
            out.clear()
            return batch

        for batch in batches:
            keys = batch.column(0).to_pylist()
            lists = [batch.column(i + 1).to_pylist() for i in range(len(columns))]
            at = 0
            while at < len(keys):
                if current is not None and keys[at] != current:
                    out.extend(each(*held))
                    held = [[] for _ in columns]
                current = keys[at]
                to = at
                while to < len(keys) and keys[to] == current:
                    to += 1
                for h, x in zip(held, lists, strict=True):
                    h.extend(x[at:to])
                at = to
                if len(out) > 50_000:
                    yield flush()
        if current is not None:
            out.extend(each(*held))
        yield flush()

    return df.select(group, *columns).repartition(F.col(group)).sortWithinPartitions(group).mapInArrow(run, schema)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words of a text as array<string>; null counts as empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def rank_buckets(rows: int, each: int = 200_000) -> int:
    """Buckets for ``rank_within``: so many that one of them holds about ``each`` rows even if one key holds all."""
    return max(64, -(-rows // each))


def rank_within(df: DataFrame, key: str, ties: list[str], rank: str, buckets: int = 1024) -> DataFrame:
    """Adds ``rank``: 0-based place of each row among the rows of its ``key``, in an order fixed by ``ties``.

    A key may hold a third of all rows, so it is never sorted in one task: rows are
    split by a hash of ``ties`` into ``buckets`` per key, ranked inside a bucket, and
    moved by the number of rows in the key's earlier buckets.  Rows equal in all of
    ``ties`` are interchangeable.  Null keys form a key of their own.
    """
    # one hash of the key serves counting, ranking and joining, so rows are dealt once
    split = df.withColumns({"_rk_code": F.xxhash64(key), "_rk_bucket": F.pmod(F.xxhash64(*ties), F.lit(buckets)).cast("int")})
    sizes = split.groupBy("_rk_code", "_rk_bucket").agg(F.count(F.lit(1)).alias("_rk_size"))
    before = Window.partitionBy("_rk_code").orderBy("_rk_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_rk_code", "_rk_bucket", F.coalesce(F.sum("_rk_size").over(before), F.lit(0)).alias("_rk_before"))
    inside = split.withColumn("_rk_place", F.row_number().over(Window.partitionBy("_rk_code", "_rk_bucket").orderBy(*ties)))
    joined = inside.join(sizes, ["_rk_code", "_rk_bucket"])
    return joined.withColumn(rank, F.col("_rk_before") + F.col("_rk_place") - 1).drop("_rk_code", "_rk_bucket", "_rk_before", "_rk_place")


# ---------------------------------------------------------------- whole columns of text in numpy

_R = 0x9E3779B97F4A7C15  # odd multiplier of the rolling hash modulo 2**64
_R_INV = pow(_R, -1, 1 << 64)
_POW: dict[int, np.ndarray] = {}
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_SPACE = ASCII_SPACE = np.zeros(256, dtype=bool)
ASCII_SPACE[[32, *range(9, 14)]] = True


def powers(n: int, base: int = _R) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, and grown by doubling."""
    have = _POW.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        have = _POW[base] = np.multiply.accumulate(out)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64, so that every bit depends on every bit."""
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and the n+1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and len(column) else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    inside = ~_SPACE[data]
    border = np.zeros(n + 1, bool)  # a text begins here: words of neighbours stay apart
    border[offsets] = True
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | border[1:-1]
    finishes[:-1] &= ~inside[1:] | border[1:-1]
    starts = np.flatnonzero(begins)
    number = np.diff(np.searchsorted(starts, offsets))
    return starts, np.flatnonzero(finishes) + 1, np.repeat(np.arange(len(number)), number)


_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True, seed: int = 0) -> np.ndarray:
    """64-bit hash of the bytes of each word (A-Z lowered); another ``seed`` gives an independent one.

    Eight bytes at a time go through a bijective mixer keyed by their place, so that no pattern of
    a long word cancels out, as it would in a polynomial modulo 2**64.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:-8] = _LOWERED[data] if lower else data
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))  # the eight bytes from each place on
    size = ends - starts
    steps = (size + 7) >> 3
    key = np.uint64((0xD6E8FEB86659FD93 * (2 * seed + 1)) & (1 << 64) - 1)
    if steps.max() == 1:
        total = mixed((eight[starts] & _KEEP[size]) ^ key)
    else:
        first = np.cumsum(steps) - steps
        step = np.arange(int(steps.sum())) - np.repeat(first, steps)
        at = np.repeat(starts, steps) + 8 * step
        part = eight[at] & _KEEP[np.minimum(np.repeat(ends, steps) - at, 8)]
        place = mixed(step.astype(np.uint64) * np.uint64(_R)) ^ key  # 0 stays 0: short words hash alike on both paths
        total = np.add.reduceat(mixed(part ^ place), first)
    return mixed(total + size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def byte_batches(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about ``most`` bytes of text, or a single longer text."""
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, offsets = text_buffer(batch.column(column))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
                yield batch.slice(at, to - at)
                at = to
    finally:  # workers outlive their tasks: an idle one keeps no tables
        _POW.clear()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library can hand freed memory back
            ctypes.CDLL(None).malloc_trim(0)
