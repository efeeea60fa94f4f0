"""Connected components of a graph given as edges, by joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from passagelake.session import reliable


def connected_components(edges: DataFrame) -> DataFrame:
    """Component of every node of ``edges`` (a, b): rows (node, component), the smallest node.

    Large-star and small-star steps alternate until nothing changes, so the number
    of rounds grows with the logarithm of a component's size. Each round's edges
    are a table in the shared folder; nothing is collected but counts. A node with
    a third of all edges is no problem: its minimum is partly aggregated, and joins
    on it are split by adaptive execution. Self edges are allowed.
    """
    pairs = reliable(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    # Rows are distinct, so their number and the sum of their hashes tell tables apart.
    before = _signature(pairs)
    while before[0]:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, larger_only=True)
        pairs = reliable(_star(large, larger_only=False))
        after = _signature(pairs)
        if after == before:
            break
        before = after
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.distinct()
    )


def _signature(pairs: DataFrame) -> tuple:
    first, second = F.xxhash64("a", "b"), F.xxhash64("b", "a")
    return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(first), F.bit_xor(second)).first())


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Link neighbours to the smallest node around a node: the larger ones, or itself and the smaller ones."""
    lowest = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = edges.join(lowest, "a")
    if larger_only:
        linked = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        others = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        linked = others.unionByName(lowest.select("a", F.col("m").alias("b")))
    return linked.where(F.col("a") != F.col("b")).distinct()
