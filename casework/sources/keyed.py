"""Tables stored by key, of which a set of keys opens only its own part."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_ROWS = 1 << 17  # so that what one key opens does not grow with the table
_BUCKET = "_bucket"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int").alias(_BUCKET)


@dataclass(frozen=True)
class Keyed:
    """A table in folders by the hash of ``key``; ``rows`` lists its files once."""

    rows: DataFrame
    key: str
    buckets: int

    def of(self, keys: DataFrame) -> DataFrame:
        """Rows whose key is in the one column of ``keys`` (any number of times, nulls allowed).

        The buckets of the keys are taken first, at most one number per key and per bucket, so
        Spark opens their folders and no others.
        """
        asked, opened = keys.toDF(self.key), self.rows
        if self.buckets > 1:
            met = asked.select(bucket_of(self.key, self.buckets)).distinct().collect()
            opened = opened.where(F.col(_BUCKET).isin([r[0] for r in met]))
        return opened.join(asked, self.key, "left_semi").drop(_BUCKET)


def store_by_key(table: DataFrame, key: str, path: str, bucket_rows: int = BUCKET_ROWS) -> Keyed:
    """Writes ``table`` to ``path`` in buckets of about ``bucket_rows`` rows each.

    All rows of a key are in one bucket, in several files where they are many: the rebalancing
    splits a large bucket among tasks. Rows with a null key are kept and never found.
    """
    buckets = max(1, -(-table.count() // bucket_rows))
    dealt = table.withColumn(_BUCKET, bucket_of(key, buckets)).hint("rebalance", _BUCKET)
    dealt.sortWithinPartitions(_BUCKET, key).write.partitionBy(_BUCKET).parquet(path)
    return Keyed(table.sparkSession.read.schema(dealt.schema).parquet(path), key, buckets)


def rows_of_keys(table: DataFrame | Keyed, key: str, keys: DataFrame) -> DataFrame:
    """Rows of a plain or a keyed table whose ``key`` is in the one column of ``keys``."""
    if isinstance(table, Keyed):
        if table.key != key:
            raise ValueError(f"stored by {table.key}, asked by {key}")
        return table.of(keys)
    return table.join(keys.toDF(key), key, "left_semi")
