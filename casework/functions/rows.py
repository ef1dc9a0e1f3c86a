"""Row-level helpers on whole DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds ``columns``, each evaluated once per row whatever follows.

    A filter on a plain derived column is pushed below the projection and evaluates its
    expression again there. Filters are not pushed through a generator, so the values come out of
    a one-element ``inline``. For parsing and embedding, where twice is twice the bill.
    """
    values = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return rows.select("*", F.inline(values))


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt evenly to twice as many tasks as there are cores.

    A Parquet row group is read by one task, however large it is, and that task also does whatever
    follows without a shuffle. For work that costs more than moving the rows.
    """
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)
