"""Joins and groupings that stay splittable when one key holds much of the table.

Adaptive execution splits a skewed join only when both inputs come straight from a shuffle of
their own and nothing above relies on the join's partitioning. A lookup table that was just
aggregated by the key, or a grouping by the same key above the join, breaks that: the shuffle is
shared and the hot key stays in one task. Wrapping the key in a struct makes it another key to
the planner, so each side gets its own shuffle and the split goes ahead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _wrapped(*keys: Column) -> Column:
    return F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])


def lookup(
    fact: DataFrame,
    dim: DataFrame,
    key: str | list[str],
    how: str = "left",
    given: Column | None = None,
) -> DataFrame:
    """``fact`` (any rows per key) joined to ``dim`` (one row per key, or a few).

    ``given`` replaces the fact side of a single key. Null keys find nothing.
    """
    keys = [key] if isinstance(key, str) else key
    for k in keys:
        dim = dim.where(F.col(k).isNotNull())
    dim = dim.withColumnsRenamed({k: f"_dim_{k}" for k in keys})
    fact_keys = [given] if given is not None else [F.col(k) for k in keys]
    on = _wrapped(*fact_keys) == _wrapped(*[F.col(f"_dim_{k}") for k in keys])
    return fact.join(dim, on, how).drop(*[f"_dim_{k}" for k in keys])


def aggregate_apart(rows: DataFrame, key: str, **aggregates: Column) -> DataFrame:
    """``rows`` grouped by ``key`` in a shuffle of its own, after map-side combining."""
    grouped = rows.groupBy(F.struct(key).alias("_key"))
    combined = grouped.agg(*[a.alias(n) for n, a in aggregates.items()])
    return combined.select(f"_key.{key}", *aggregates)
