"""Shared scratch space: where intermediate tables are frozen to cut lineage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder of its own; on a
    cluster such a folder would not outlive its executor, so the setting is required there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="casework-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


_scopes: list[list[str]] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path no earlier run has used; it belongs to the innermost open ``scratch``."""
    path = f"{shared_root(spark).rstrip('/')}/casework/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder on any store; one that is not there is fine."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(conf).delete(place, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Owns every scratch path made inside, and drops them at the end.

    A result that is read lazily must be written inside:

        with scratch(spark):
            near_duplicates(docs).write.parquet(target)
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            drop(spark, path)


@contextlib.contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, what a job has shuffled is deleted as soon as its result is written.

    Otherwise it stays until the driver happens to collect its garbage, beside all that later jobs
    shuffle. Only for jobs of which every result is frozen.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def release(df: DataFrame) -> None:
    """Deletes a frozen table that nothing will read again."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/casework/" in path:
            drop(df.sparkSession, path)


def freeze(df: DataFrame, label: str, **options: int) -> DataFrame:
    """Write ``df`` once and read it back, so values that depend on task layout stay fixed.

    ``options`` are the writer's.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
