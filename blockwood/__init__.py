"""Blockwood: hierarchical low-rank matrices and data pipelines on Spark DataFrames."""

from __future__ import annotations

from pyspark.sql import SparkSession

__version__ = "0.1.0"


def ship(spark: SparkSession) -> None:
    """Hands this package to the executors' Python workers, once per Spark context."""
    import tempfile
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_blockwood_shipped", False):
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / f"blockwood-{__version__}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(here.rglob("*.py")):
            z.write(path, path.relative_to(here.parent))
    context.addPyFile(str(target))
    context._blockwood_shipped = True
