"""Reading the given tables, naming their rows, and bringing this package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives executors this package's modules, through Spark's own file server, once a session.

    The archive is made in a folder of the driver's, which no executor reads.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="casework-")) / "casework.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_key(text: str = "text") -> Column:
    """With doc_id this names a row: rows that agree in both are the same document.

    Nothing is named by its place in a file, so a repeated task names the same rows the same way.
    """
    return F.coalesce(F.xxhash64(F.col(text)), F.lit(0)).alias("text_key")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]
