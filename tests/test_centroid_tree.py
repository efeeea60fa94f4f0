"""A tree of centroids gives what the flat search gives."""

import numpy as np
import pytest

from passagelake.operators.centroid_tree import assign_tree, build_tree, route_tree, train_leaves
from passagelake.operators.centroids import MAX_CENTROIDS, assign_nearest, route

ROWS = "chunk_id string, embedding array<float>"
CENTRES = "centroid_idx int, centroid array<double>"


def clustered(rng, rows, dim, groups=30, spread=0.1):
    middles = rng.normal(size=(groups, dim))
    return middles[rng.integers(0, groups, rows)] + spread * rng.normal(size=(rows, dim))


def frame(spark, matrix):
    return spark.createDataFrame([(f"v{i}", [float(x) for x in r]) for i, r in enumerate(matrix)], ROWS)


def centre_frame(spark, matrix):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(matrix)], CENTRES)


def key(rows, *columns):
    return sorted(tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in columns) for r in rows)


def test_exact_mode_equals_the_flat_search(spark):
    rng = np.random.default_rng(3)
    centres = clustered(rng, 400, 8)
    centres[7] = centres[399]  # equal centroids: the lower index wins
    vectors = frame(spark, np.concatenate([clustered(rng, 600, 8), np.repeat(centres[7:8], 300, axis=0)]))
    flat = centre_frame(spark, centres)
    tree = build_tree(flat)
    columns = "chunk_id", "centroid_idx", "centroid_distance"
    assert key(assign_tree(vectors, tree).collect(), *columns) == key(assign_nearest(vectors, flat).collect(), *columns)
    probes = "chunk_id", "probe", "centroid_idx", "centroid_distance"
    for nprobe in (3, 50):
        ours = key(route_tree(vectors, tree, nprobe).collect(), *probes)
        assert ours == key(route(vectors, flat, nprobe).collect(), *probes)


def test_more_probes_than_centroids_and_odd_rows(spark):
    flat = centre_frame(spark, np.eye(3))
    rows = [("a", [1.0, 0, 0]), ("a", [1.0, 0, 0]), ("b", None), ("c", [1.0]), ("d", [float("nan"), 0, 0]), (None, [0, 0, 1.0])]
    vectors = spark.createDataFrame([(i, v and [float(x) for x in v]) for i, v in rows], ROWS)
    tree = build_tree(flat, branches=2)
    got = sorted((str(r.chunk_id), r.centroid_idx) for r in assign_tree(vectors, tree).collect())
    assert got == [("None", 2), ("a", 0), ("a", 0)]
    assert route_tree(vectors, tree, 10).count() == 9
    assert assign_tree(vectors.limit(0), tree).count() == 0
    with pytest.raises(ValueError):
        build_tree(flat.limit(0))


def test_beam_is_nearly_exact_and_opens_less(spark):
    rng = np.random.default_rng(5)
    centres, matrix = clustered(rng, 900, 16), clustered(rng, 1000, 16)
    tree = build_tree(centre_frame(spark, centres))
    exact = {r.chunk_id: r.centroid_idx for r in assign_tree(frame(spark, matrix), tree).collect()}
    beam = {r.chunk_id: r.centroid_idx for r in assign_tree(frame(spark, matrix), tree, beam=4).collect()}
    assert np.mean([beam[k] == v for k, v in exact.items()]) >= 0.9


def test_past_the_flat_limit(spark):
    from pyspark.sql import functions as F

    count = 200_000
    spot = lambda n: F.array(*[F.cos(F.col("id") * w + n) for w in (0.37, 1.13, 2.71, 0.011)])
    many = spark.range(count).select(F.col("id").cast("int").alias("centroid_idx"), spot(0.0).alias("centroid"))
    vectors = spark.range(500).select(F.col("id").cast("string").alias("chunk_id"), spot(0.3).alias("embedding"))
    assert count > MAX_CENTROIDS
    tree = build_tree(many, branches=200)
    got = {int(r.chunk_id): r for r in assign_tree(vectors, tree).collect()}
    centres = np.array([r.centroid for r in many.orderBy("centroid_idx").collect()])
    for r in vectors.collect():
        gaps = np.sqrt(np.square(centres - np.array(r.embedding)).sum(axis=1))
        found = got[int(r.chunk_id)]
        assert abs(found.centroid_distance - gaps.min()) < 1e-9
        assert found.centroid_idx == gaps.argmin()


def test_trained_leaves(spark):
    rng = np.random.default_rng(8)
    matrix = clustered(rng, 3000, 8, groups=60, spread=0.02)
    matrix[:1000] = matrix[0]  # a third are copies of one vector
    vectors = frame(spark, matrix)
    leaves = train_leaves(vectors, 120)
    numbers = sorted(r.centroid_idx for r in leaves.collect())
    assert numbers == list(range(len(numbers))) and 60 <= len(numbers) <= 150
    placed = assign_tree(vectors, build_tree(leaves)).collect()
    assert len(placed) == 3000
    assert np.median([r.centroid_distance for r in placed]) < 0.1
