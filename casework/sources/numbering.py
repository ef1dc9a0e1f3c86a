"""Dense numbers over a whole table without one global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.workspace import freeze

_PARTITION_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def dense_numbers(
    rows: DataFrame, order: list[str | Column], name: str, start: int = 0
) -> DataFrame:
    """Adds ``name`` = start + 1, start + 2, … in ``order``.

    Rows are range-partitioned and sorted, their (partition, position) is written down once, and
    each partition is then shifted by the row counts before it. One shuffle of the rows: the
    counts, one number per partition, come to the driver and go back as a broadcast of that size.
    The rows are frozen before the counts are taken, because a recomputed range partitioning may
    draw its borders elsewhere.
    """
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = freeze(spread.withColumn("_at", F.monotonically_increasing_id()), "numbering")
    part = F.shiftright("_at", _PARTITION_BITS)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before, offsets = start, []
    for at, n in sorted(tuple(r) for r in counts.collect()):
        offsets.append((at, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(offsets, "_part long, _before long")
    position = F.col("_at").bitwiseAND(F.lit((1 << _PARTITION_BITS) - 1)) + 1
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + position)
        .drop("_part", "_at", "_before")
    )
