"""Tables in versions: a merge rewrites the buckets it touches, and readers see whole versions only.

``Versioned`` keeps a table by the hash of its key. A version is a list of (bucket, folder), written
beside the data and published last by an empty marker file, which appears at once or not at all.
What an unpublished attempt leaves behind no reader opens, and the next attempt writes it over.
``publish_batch`` does the same for logs, where every batch has a marker of its own.

One writer at a time: two merges begun from one version would publish the same number, and the
second fails at the marker.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from casework.sources.keyed import BUCKET_ROWS, bucket_of
from casework.sources.tables import upsert
from casework.workspace import drop

_BUCKET, _FOLDER = "_bucket", "_folder"
_PLACES = f"{_BUCKET} int, {_FOLDER} string"


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; one that is not there has none."""
    fs, place = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []


def _mark(spark: SparkSession, path: str) -> None:
    """An empty file that must not be there yet."""
    fs, place = _fs(spark, path)
    fs.create(place, False).close()


@dataclass(frozen=True)
class Versioned:
    """A table at ``path``; every read sees the version published last when the read is set up."""

    spark: SparkSession
    path: str
    key: str
    buckets: int
    schema: StructType

    def versions(self) -> list[int]:
        return sorted(int(n) for n in _names(self.spark, f"{self.path}/published"))

    def _places(self, version: int) -> DataFrame:
        return self.spark.read.schema(_PLACES).parquet(f"{self.path}/places/{version}")

    def _open(self, version: int, only: list[int] | None = None) -> DataFrame:
        """Rows of a version, of the given buckets or of all.

        The folders come to the driver, one name per bucket, where Spark lists a table's files
        anyway.
        """
        places = self._places(version)
        if only is not None:
            places = places.where(F.col(_BUCKET).isin(only))
        paths = [f"{self.path}/data/{r[_FOLDER]}/{_BUCKET}={r[_BUCKET]}" for r in places.collect()]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*sorted(paths))

    def rows(self, version: int | None = None) -> DataFrame:
        return self._open(self.versions()[-1] if version is None else version)

    def of(self, keys: DataFrame) -> DataFrame:
        """Rows whose key is in the one column of ``keys``; their buckets only are opened."""
        asked = self._typed(keys.toDF(self.key)).where(F.col(self.key).isNotNull())
        return self._open(self.versions()[-1], self._met(asked)).join(asked, self.key, "left_semi")

    def _typed(self, keyed: DataFrame) -> DataFrame:
        """With the key in the table's type, since the bucket of a value depends on its type."""
        return keyed.withColumn(self.key, F.col(self.key).cast(self.schema[self.key].dataType))

    def _met(self, keyed: DataFrame) -> list[int]:
        """The buckets of a batch: at most one number per row and per bucket."""
        return [r[0] for r in keyed.select(bucket_of(self.key, self.buckets)).distinct().collect()]

    def _write(self, rows: DataFrame, folder: str) -> DataFrame:
        """Writes ``rows`` by bucket; returns the places of what came out."""
        dealt = rows.withColumn(_BUCKET, bucket_of(self.key, self.buckets)).hint("rebalance", _BUCKET)
        at = f"{self.path}/data/{folder}"
        dealt.sortWithinPartitions(_BUCKET, self.key).write.mode("overwrite").partitionBy(_BUCKET).parquet(at)
        found = [n.split("=")[1] for n in _names(self.spark, at) if n.startswith(f"{_BUCKET}=")]
        return self.spark.createDataFrame([(int(b), folder) for b in found], _PLACES)

    def _publish(self, places: DataFrame, version: int) -> None:
        places.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/places/{version}")
        _mark(self.spark, f"{self.path}/published/{version}")

    def merge(
        self, source: DataFrame, seq: str, loaded_at: Column,
        created: str = "created_at", touched: str | None = "updated_at",
    ) -> int:
        """``upsert`` of ``source`` as a new version; returns its number.

        Only the buckets that hold a key of the batch are read and written, in folders of the new
        version; all others are taken over as they are. Repeated keys: the last by ``seq``. A null
        key is a row of its own each time, as in ``upsert``. An empty batch publishes nothing.
        """
        last, source = self.versions()[-1], self._typed(source)
        met = self._met(source)
        if not met:
            return last
        merged = upsert(self._open(last, met), source, self.key, seq, loaded_at, created, touched)
        new = self._write(merged, f"v{last + 1}")
        kept = self._places(last).where(~F.col(_BUCKET).isin(met))
        self._publish(kept.unionByName(new), last + 1)
        return last + 1

    def drop_old(self, keep: int = 2) -> None:
        """Forgets all but the last ``keep`` versions, and data that none of those uses.

        A reader of a version older than that loses its files. Markers go before the data, so a
        version that is half gone is not listed.
        """
        held = self.versions()
        old, kept = held[:-keep], held[-keep:]
        for v in old:
            drop(self.spark, f"{self.path}/published/{v}")
        used = {(r[_FOLDER], r[_BUCKET]) for v in kept for r in self._places(v).collect()}
        for folder in _names(self.spark, f"{self.path}/data"):
            if int(folder[1:]) > held[-1]:
                continue  # an attempt that may still be running
            for name in _names(self.spark, f"{self.path}/data/{folder}"):
                if name.startswith(f"{_BUCKET}=") and (folder, int(name.split("=")[1])) not in used:
                    drop(self.spark, f"{self.path}/data/{folder}/{name}")
        for v in old:
            drop(self.spark, f"{self.path}/places/{v}")


def create_table(
    table: DataFrame, key: str, path: str, bucket_rows: int = BUCKET_ROWS, expected_rows: int = 0
) -> Versioned:
    """Writes ``table`` as version 0, in buckets of about ``bucket_rows`` rows each.

    The number of buckets stays, so say how many rows are expected of a table that begins small;
    one that outgrows it is created again. Until version 0 is
    published there is no table, and creating it again is fine.
    """
    spark, path = table.sparkSession, path.rstrip("/")
    if _names(spark, f"{path}/published"):
        raise ValueError(f"there is a table at {path}")
    buckets = max(1, -(-max(table.count(), expected_rows) // bucket_rows))
    layout = json.dumps({"key": key, "buckets": buckets, "schema": table.schema.jsonValue()})
    spark.createDataFrame([(layout,)], "layout string").write.mode("overwrite").parquet(f"{path}/layout")
    new = Versioned(spark, path, key, buckets, table.schema)
    new._publish(new._write(table, "v0"), 0)
    return new


def open_table(spark: SparkSession, path: str) -> Versioned:
    path = path.rstrip("/")
    if not _names(spark, f"{path}/published"):
        raise ValueError(f"no table at {path}")
    layout = json.loads(spark.read.schema("layout string").parquet(f"{path}/layout").first()[0])
    schema = StructType.fromJson(layout["schema"])
    return Versioned(spark, path, layout["key"], layout["buckets"], schema)


def publish_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """The rows of a batch of a log. Publishing a batch again replaces its rows, all at once.

    Each attempt has a folder, and a marker ``batch-attempt`` says that it is whole; the highest
    attempt counts. The one before stays for readers under way, older ones go.
    """
    spark, path = rows.sparkSession, path.rstrip("/")
    tries = sorted(a for b, a in _attempts(spark, path) if b == batch_id)
    new = f"{batch_id}-{tries[-1] + 1 if tries else 0}"
    rows.write.mode("overwrite").parquet(f"{path}/data/{new}")
    _mark(spark, f"{path}/published/{new}")
    for old in tries[:-1]:
        drop(spark, f"{path}/published/{batch_id}-{old}")
        drop(spark, f"{path}/data/{batch_id}-{old}")


def _attempts(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    split = [n.split("-") for n in _names(spark, f"{path}/published")]
    return [(int(b), int(a)) for b, a in split]


def read_batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All published batches, each in its last attempt; none gives an empty table."""
    path = path.rstrip("/")
    latest = dict(sorted(_attempts(spark, path)))
    if not latest:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/data/{b}-{a}" for b, a in latest.items()])
