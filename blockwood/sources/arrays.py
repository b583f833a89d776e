"""Dense arrays as files: five 32-bit integers (type, rows, columns, bytes a number, 0), then the numbers column by column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship

# fixed values of the file format, by type code
TYPES = {"S": (0, np.dtype("<f4")), "D": (1, np.dtype("<f8")), "C": (2, np.dtype("<c8")), "Z": (3, np.dtype("<c16"))}
STRETCH = 1 << 18  # numbers of a column that travel in one row


def write_array(values: DataFrame, path: str, rows: int, cols: int, scalar: str = "D") -> None:
    """``values`` (row, col, re and, for complex types, im; what is missing is 0) as one file of any file system that Spark reaches.

    Stretches of columns are packed over the cluster and pass the driver in file order, a partition at a time.  Places that
    occur twice or lie outside of the array are errors.
    """
    spark = values.sparkSession
    ship(spark)
    code, kind = TYPES[scalar]
    im = F.col("im").cast("double") if scalar in "CZ" else F.lit(0.0)
    cells = values.select(F.col("row").cast("long"), F.col("col").cast("long"), F.col("re").cast("double"), im.alias("im"))
    if cells.where(~(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)) | F.col("row").isNull() | F.col("col").isNull()).limit(1).count():
        raise ValueError("a place outside of the array")

    def pack(table: pa.Table) -> pa.Table:
        row, col = np.asarray(table.column("row")), table.column("col")[0].as_py()
        first = int(row[0]) // STRETCH * STRETCH
        if len(np.unique(row)) < len(row):
            raise ValueError("a place occurs twice")
        out = np.zeros(min(STRETCH, rows - first), np.complex128)
        out[row - first] = np.asarray(table.column("re")) + 1j * np.asarray(table.column("im"))
        out = (out if scalar in "CZ" else out.real).astype(kind)
        return pa.table({"at": pa.array([col * rows + first], pa.int64()), "body": pa.array([out.tobytes()], pa.binary())})

    packed = cells.withColumn("part", F.expr(f"row div {STRETCH}")).groupBy("col", "part").applyInArrow(pack, "at long, body binary").orderBy("at")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        stream.write(bytearray(np.array([code, rows, cols, kind.itemsize, 0], "<i4").tobytes()))
        done = 0

        def zeros(to: int) -> None:
            left = (to - done) * kind.itemsize
            while left > 0:
                stream.write(bytearray(min(left, 1 << 20)))
                left -= 1 << 20

        for r in packed.toLocalIterator():
            zeros(r["at"])
            stream.write(r["body"])
            done = r["at"] + len(r["body"]) // kind.itemsize
        zeros(rows * cols)
    finally:
        stream.close()


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, col, re, im) of one or several array files of up to 2 GB each; a broken header or length is an error."""
    ship(spark)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {code: kind for code, kind in TYPES.values()}
        for batch in batches:
            for file, body in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = memoryview(body.as_buffer())
                code, rows, cols, size = np.frombuffer(data[:20], "<i4")[:4].tolist() if len(data) >= 20 else (-1, 0, 0, 0)
                if code not in kinds or kinds[code].itemsize != size or len(data) != 20 + rows * cols * size:
                    raise ValueError(f"not an array file: {file}")
                every = np.frombuffer(data[20:], kinds[code])
                for at in range(0, len(every), STRETCH):
                    some, place = every[at : at + STRETCH], np.arange(at, min(at + STRETCH, len(every)))
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(some)), pa.array(place % rows), pa.array(place // rows), pa.array(some.real.astype(np.float64)), pa.array(some.imag.astype(np.float64))], names=["file", "row", "col", "re", "im"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(numbers, "file string, row long, col long, re double, im double")
