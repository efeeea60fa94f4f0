"""Exact top-k that opens few shards: distance bounds by the triangle inequality.

A shard lies inside a ball: its vectors are no further from the centroid than its radius.
That bounds every score a query can reach in it. Each query opens its shards in the order
of these bounds, a few at a time, and stops when no unopened shard can still improve its
k-th score. The result is that of an exact search of all shards, whatever the centroids.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from passagelake.functions.vectors import inner_product, l2_distance, to_matrix, unit_rows
from passagelake.operators.centroids import centroid_matrix
from passagelake.operators.search import (
    BROADCAST_NUMBERS,
    BROADCAST_QUERIES,
    METRICS,
    TOP_K,
    hit_schema,
    key_columns,
    query_blocks,
    rank_hits,
    scan_routed,
)
from passagelake.session import reliable

#: Bounds of queries and shards held at once on the driver.
BOUND_NUMBERS = 8 * 1024 * 1024
#: Bounds and scores are compared with this much room for rounding.
ROOM = 1e-7


def shard_balls(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """One row per shard: radius around the centroid, least and largest length of a vector."""
    # One row per centroid, and their number has been checked.
    placed = vectors.select("centroid_idx", "embedding").join(F.broadcast(centroids), "centroid_idx")
    length = F.sqrt(inner_product(F.col("embedding"), F.col("embedding")))
    measured = placed.select("centroid_idx", l2_distance(F.col("embedding"), F.col("centroid")).alias("d"), length.alias("n"))
    return measured.groupBy("centroid_idx").agg(
        F.max("d").alias("radius"), F.min("n").alias("shortest"), F.max("n").alias("longest")
    )


def score_bounds(
    texts: np.ndarray, matrix: np.ndarray, radius: np.ndarray, shortest: np.ndarray, longest: np.ndarray, metric: str
) -> np.ndarray:
    """The most that each query (row) can score in each shard (column)."""
    texts = np.asarray(texts, dtype=np.float64)
    if metric == "l2":
        gaps = np.square(texts).sum(1)[:, None] + np.square(matrix).sum(1)[None, :] - 2 * texts @ matrix.T
        away = np.maximum(np.sqrt(np.maximum(gaps, 0.0)) - radius[None, :], 0.0)
        return 1.0 - np.square(away) + ROOM * (1 + gaps)
    most = unit_rows(texts) @ matrix.T + radius[None, :]
    most += ROOM * (1 + np.abs(most))
    if metric == "inner":
        return np.minimum(most, longest[None, :] * (1 + ROOM) + ROOM)
    # A positive product is largest over the shortest vector, a negative one over the longest.
    length = np.where(most > 0, shortest[None, :], longest[None, :])
    return np.where(length > 0, np.minimum(most / np.maximum(length, 1e-300), 1 + ROOM), 1 + ROOM)


def bounded_topk(
    queries: DataFrame,
    vectors: DataFrame,
    centroids: DataFrame,
    k: int = TOP_K,
    metric: str = "inner",
    balls: DataFrame | None = None,
    block_queries: int = BROADCAST_QUERIES,
) -> tuple[DataFrame, DataFrame]:
    """(hits, opened): the exact top-k rows, as ``search_vectors`` probing all shards, and query_id with shards_opened.

    ``vectors`` has centroid_idx, chunk_id, embedding and perhaps label, ``balls`` what
    ``shard_balls`` gives for them, where it is stored. Queries pass by in blocks of bounded
    size; a shard is read in the rounds in which a query of the block opens it. The driver
    sees bounds and k-th scores of a block only. Queries of another dimension or with
    gaps give no rows.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    spark = queries.sparkSession
    names, matrix = centroid_matrix(centroids)
    dim = matrix.shape[1]
    found = {r.centroid_idx: r for r in (shard_balls(vectors, centroids) if balls is None else balls).collect()}
    used = np.array([i for i, c in enumerate(names.tolist()) if c in found], dtype=np.int64)
    names, matrix = names[used], matrix[used]
    ball = [np.array([found[c][n] for c in names.tolist()], dtype=float) for n in ("radius", "shortest", "longest")]
    keys = key_columns(vectors)
    schema = hit_schema(queries, vectors, keys)
    kind = schema["query_id"].dataType
    hits = [spark.createDataFrame([], T.StructType([*schema, T.StructField("rank", T.IntegerType())]))]
    opened = [spark.createDataFrame([], T.StructType([schema["query_id"], T.StructField("shards_opened", T.LongType())]))]
    # Inside a block, queries are known by their places.
    placed = T.StructType([T.StructField("query_id", T.LongType()), *schema.fields[1:]])
    usable = queries.where(F.size("embedding") == dim).select("query_id", "embedding")
    most = min(block_queries, BROADCAST_NUMBERS // max(1, dim), BOUND_NUMBERS // max(1, len(names)))
    for block in query_blocks(usable, max(1, most)) if len(names) else ():
        texts, fits = to_matrix(block.column("embedding"), dim)
        ids = [q for q, f in zip(block.column("query_id").to_pylist(), fits.tolist()) if f]
        if not ids:
            continue
        bounds = score_bounds(texts, matrix, *ball, metric)
        best, counts = _open_shards(vectors, texts, names, bounds, k, metric, placed, keys)
        rows = [(place, q, int(n)) for place, (q, n) in enumerate(zip(ids, counts))]
        named = T.StructType([T.StructField("_place", T.LongType()), T.StructField("_id", kind), T.StructField("n", T.LongType())])
        asked = reliable(spark.createDataFrame(rows, named))
        found_here = best.withColumnRenamed("query_id", "_place").join(F.broadcast(asked), "_place")
        hits.append(found_here.select(F.col("_id").alias("query_id"), *keys, "score", "rank"))
        opened.append(asked.select(F.col("_id").alias("query_id"), F.col("n").alias("shards_opened")))
    return reduce(DataFrame.unionByName, hits), reduce(DataFrame.unionByName, opened)


def _open_shards(vectors, texts, names, bounds, k, metric, schema, keys) -> tuple[DataFrame, np.ndarray]:
    """The ranked hits of a block of queries (by place), and how many shards each opened."""
    order = np.argsort(-bounds, axis=1, kind="stable")
    falling = np.take_along_axis(bounds, order, axis=1)
    opened = np.zeros(len(texts), dtype=np.int64)
    bar = np.full(len(texts), -np.inf)
    best, width = None, 1
    while True:
        # Bounds fall along a row: what can still improve a query is a run of its next shards.
        wanted = np.minimum((falling >= bar[:, None]).sum(1), opened + width)
        routed: dict[int, list[int]] = {}
        for place in np.flatnonzero(wanted > opened).tolist():
            for shard in order[place, opened[place] : wanted[place]].tolist():
                routed.setdefault(int(names[shard]), []).append(place)
        if not routed:
            return best, opened
        opened = np.maximum(opened, wanted)
        pruned = vectors.where(F.col("centroid_idx").isin(list(routed)))
        where = {shard: np.array(places) for shard, places in routed.items()}
        new = scan_routed(pruned, texts, np.arange(len(texts)), where, k, metric, schema, keys)
        best = reliable(rank_hits(new if best is None else new.unionByName(best.drop("rank")), k))
        for row in best.where(F.col("rank") == k).select("query_id", "score").collect():
            bar[row["query_id"]] = row["score"]
        width *= 2
