"""Centroids: training, per-group means, nearest-centroid assignment and routing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

from passagelake.functions.vectors import MAX_BROADCAST_NUMBERS, nearest, to_matrix
from passagelake.operators.sampling import sample_rows, shuffle_key
from passagelake.schemas import CENTROIDS
from passagelake.session import reliable

# Training defaults.
NUM_CENTROIDS = 30
TRAINING_ROWS = 3000
SEED = 42

# By default the sample grows with the number of centroids.
ROWS_PER_CENTROID = 50
ROWS_PER_TASK = 20_000

MAX_CENTROIDS = 65_536


def train_centroids(
    vectors: DataFrame,
    key_col: str = "chunk_id",
    vector_col: str = "embedding",
    num_centroids: int = NUM_CENTROIDS,
    max_samples: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """K-means centres (centroid_idx, centroid) of a seeded sample of the vectors.

    Only the sample is trained on, so the fit costs the same at any table size. It
    has 3,000 rows, or 50 for each centroid if that is more; a sample smaller than
    the number of centroids is an error. There are never more centres than distinct
    vectors; no vectors, no centres.
    """
    if max_samples is None:
        max_samples = max(TRAINING_ROWS, ROWS_PER_CENTROID * num_centroids)
    if num_centroids > max_samples:
        raise ValueError(f"{max_samples} samples cannot give {num_centroids} centroids")
    usable = vectors.where(F.col(vector_col).isNotNull()).select(key_col, vector_col)
    # All rows are counted, which needs no column; missing vectors hardly matter here.
    sample = sample_rows(usable, key_col, max_samples, seed, total=vectors.count())
    # The sample comes sorted, in one partition: spread it for the training.
    sample = sample.select(vector_col).repartition(1 + max_samples // ROWS_PER_TASK).persist()
    try:
        distinct = sample.distinct().count()
        if distinct == 0:
            return vectors.sparkSession.createDataFrame([], CENTROIDS)
        features = sample.select(array_to_vector(F.col(vector_col)).alias("features"))
        model = KMeans(
            k=min(num_centroids, distinct), seed=seed, initMode="k-means||"
        ).setDistanceMeasure("euclidean")
        centres = (
            model.fit(features).clusterCenters()
            if distinct > 1
            else [np.asarray(sample.first()[0], dtype=np.float64)]
        )
    finally:
        sample.unpersist()
    return vectors.sparkSession.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(centres)], CENTROIDS
    )


def group_centroids(vectors: DataFrame, group_col: str, vector_col: str = "embedding") -> DataFrame:
    """Mean vector per group (one Lloyd step); partial sums are made before the shuffle."""
    mean = Summarizer.mean(array_to_vector(F.col(vector_col)))
    return (
        vectors.where(F.col(vector_col).isNotNull())
        .groupBy(F.col(group_col).alias("centroid_idx"))
        .agg(vector_to_array(mean).alias("centroid"))
    )


def lloyd_steps(
    vectors: DataFrame,
    num_centroids: int,
    steps: int,
    key_col: str = "chunk_id",
    vector_col: str = "embedding",
    seed: int = SEED,
) -> DataFrame:
    """Centroids after some Lloyd steps over all vectors, from the first rows of the seeded shuffle.

    A centroid that no vector is nearest to stays where it is.
    """
    first = sample_rows(vectors.where(F.col(vector_col).isNotNull()), key_col, num_centroids, seed)
    order = Window.orderBy(shuffle_key(F.col(key_col), seed), key_col)
    # As many rows as centroids are numbered.
    centres = first.select(
        (F.row_number().over(order) - 1).alias("centroid_idx"),
        F.col(vector_col).cast("array<double>").alias("centroid"),
    )
    for _ in range(steps):
        centres = reliable(centres)
        means = group_centroids(assign_nearest(vectors, centres, vector_col), "centroid_idx", vector_col)
        moved = means.withColumnRenamed("centroid", "_mean")
        centres = centres.join(moved, "centroid_idx", "left").select(
            "centroid_idx", F.coalesce("_mean", "centroid").alias("centroid")
        )
    return reliable(centres)


def centroid_matrix(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Centroid indices and matrix on the driver, in index order.

    Their number is a model parameter, not a property of the data; it is checked
    all the same, and at most one row above the limit is fetched.
    """
    found = centroids.select("centroid_idx", "centroid").limit(MAX_CENTROIDS + 1).toArrow()
    if not found.num_rows:
        raise ValueError("no centroid vectors")
    if found.num_rows > MAX_CENTROIDS:
        raise ValueError(f"more than {MAX_CENTROIDS} centroids cannot be broadcast")
    matrix, fits = to_matrix(found.column("centroid"))
    if not fits.all():
        raise ValueError("centroids differ in dimension or have missing numbers")
    if matrix.size > MAX_BROADCAST_NUMBERS:
        raise ValueError(f"a {matrix.shape} centroid matrix is too large to broadcast")
    indices = found.column("centroid_idx").to_numpy().astype(np.int32)
    order = np.argsort(indices, kind="stable")
    return indices[order], matrix[order].astype(np.float64)


def dimension_rejects(vectors: DataFrame, dim: int, vector_col: str = "embedding") -> DataFrame:
    """Rows ``assign_nearest`` leaves out, with the reason."""
    vector = F.col(vector_col)
    gaps = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    reason = (
        F.when(vector.isNull(), "Missing embedding")
        .when(F.size(vector) != dim, "Vector length is not that of the centroids")
        .when(gaps, "Embedding has missing or infinite numbers")
    )
    return vectors.withColumn("reason", reason).where(F.col("reason").isNotNull())


def assign_nearest(
    vectors: DataFrame, centroids: DataFrame, vector_col: str = "embedding"
) -> DataFrame:
    """Add centroid_idx and centroid_distance to the vectors that fit the centroids.

    ``dimension_rejects`` gives the others: no vector, another dimension, gaps.

    The centroids travel to the tasks once, as a matrix, and every batch costs one
    matrix product. No join, no shuffle, no vector x centroid rows.
    """
    indices, matrix = centroid_matrix(centroids)
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast((indices, matrix))

    @F.arrow_udf("centroid_idx int, centroid_distance double")
    def assign(column: pa.Array) -> pa.Array:
        names, centres = shared.value
        block, fits = to_matrix(column, centres.shape[1])
        idx = np.zeros(len(fits), dtype=np.int32)
        dist = np.zeros(len(fits), dtype=np.float64)
        if len(block):
            best, gap = nearest(block, centres, 1)
            idx[fits], dist[fits] = names[best[:, 0]], gap[:, 0]
        return pa.StructArray.from_arrays(
            [pa.array(idx, mask=~fits), pa.array(dist, mask=~fits)],
            ["centroid_idx", "centroid_distance"],
        )

    # Not deterministic for the optimizer: a filter on the shard must not be pushed
    # below the assignment, where it would assign every row a second time.
    assign = assign.asNondeterministic()
    sized = vectors.where(
        F.col(vector_col).isNotNull() & (F.size(vector_col) == matrix.shape[1])
    )
    return sized.withColumn("_nearest", assign(vector_col)).select(
        *vectors.columns, "_nearest.centroid_idx", "_nearest.centroid_distance"
    ).where(F.col("centroid_idx").isNotNull())


def route(
    queries: DataFrame, centroids: DataFrame, nprobe: int = 3, vector_col: str = "embedding"
) -> DataFrame:
    """One row per query and routed centroid: probe (1 = nearest), centroid_idx, distance."""
    indices, matrix = centroid_matrix(centroids)
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast((indices, matrix))

    @F.arrow_udf("array<struct<centroid_idx:int,centroid_distance:double>>")
    def probes(column: pa.Array) -> pa.Array:
        names, centres = shared.value
        block, fits = to_matrix(column, centres.shape[1])
        item = pa.struct(
            [("centroid_idx", pa.int32()), ("centroid_distance", pa.float64())]
        )
        if not len(block):
            return pa.nulls(len(fits), pa.list_(item))
        best, gap = nearest(block, centres, nprobe)
        values = pa.StructArray.from_arrays(
            [pa.array(names[best].reshape(-1)), pa.array(gap.reshape(-1))],
            fields=list(item),
        )
        ends = np.concatenate([[0], np.cumsum(np.where(fits, best.shape[1], 0))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    probes = probes.asNondeterministic()
    return (
        queries.withColumn("_probes", probes(vector_col))
        .select(*queries.columns, F.posexplode("_probes").alias("_at", "_probe"))
        .select(
            *queries.columns,
            (F.col("_at") + 1).alias("probe"),
            "_probe.centroid_idx",
            "_probe.centroid_distance",
        )
    )
