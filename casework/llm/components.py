"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.operators.joins import lookup
from casework.workspace import freeze, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Neighbours of each node tied to the least of them; edges are (a, b) with a < b."""
    up = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    both = up.union(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))) if large else up
    least = both.groupBy("u").agg(F.min("v").alias("low"))
    least = least.select("u", F.least("u", "low").alias("low"))
    tied = lookup(both, least, "u", "inner")
    if large:  # every larger neighbour moves to the least
        moved = tied.where("v > u").select(F.col("low").alias("a"), F.col("v").alias("b"))
    else:  # smaller neighbours, and the node itself, move to the least
        moved = tied.select(F.col("low").alias("a"), F.col("v").alias("b")).union(
            least.select(F.col("low").alias("a"), F.col("u").alias("b")))
    return moved.where("a < b").distinct()


def _digest(edges: DataFrame) -> tuple:
    """Count and two sums of a set of edges: equal sets, equal digests, and hardly any others."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(
        F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 32)), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b): the least node it reaches.

    Each turn writes its edges to the shared folder, so lineage stays short and a lost executor
    costs one turn at most. No neighbourhood is gathered in one row.
    """
    edges = freeze(
        links.where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    seen = _digest(edges)
    while True:
        turned = freeze(_star(_star(edges, True), False), "edges")
        release(edges)
        edges, before, seen = turned, seen, _digest(turned)
        if seen == before:
            break
    ends = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return ends.union(edges.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()
