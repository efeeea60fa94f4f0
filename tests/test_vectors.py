import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from passagelake.functions.embed import HashingEmbedder, embed_column
from passagelake.functions.vectors import cosine, inner_product, l2_distance, nearest
from passagelake.operators.centroids import (
    assign_nearest,
    centroid_matrix,
    dimension_rejects,
    group_centroids,
    lloyd_steps,
    route,
    train_centroids,
)
from passagelake.operators.labels import dense_labels
from passagelake.operators.sampling import sample_rows

DDL = "chunk_id string, embedding array<float>"


def frame(spark, matrix, prefix="v"):
    rows = [(f"{prefix}{i}", [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, DDL)


def centroid_frame(spark, matrix):
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, "centroid_idx int, centroid array<double>")


def test_nearest_breaks_ties_by_index():
    centroids = np.array([[1.0, 0], [0, 1], [1, 0], [5, 5]])
    vectors = np.array([[1.0, 0], [0, 0], [0.5, 0.5], [9, 9], [0, 3]])
    idx, dist = nearest(vectors, centroids, 1)
    assert idx[:, 0].tolist() == [0, 0, 0, 3, 1]
    idx, dist = nearest(vectors, centroids, 9)
    for v, row, gaps in zip(vectors, idx, dist):
        exact = np.linalg.norm(centroids - v, axis=1)
        assert row.tolist() == sorted(range(4), key=lambda j: (exact[j], j))
        assert np.allclose(gaps, np.sort(exact))


def test_assignment_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    matrix = rng.normal(size=(3000, 16)).astype(np.float32)
    centres = rng.normal(size=(40, 16))
    got = assign_nearest(frame(spark, matrix), centroid_frame(spark, centres)).collect()
    exact = np.linalg.norm(matrix[:, None, :].astype(np.float64) - centres[None], axis=2)
    for r in got:
        i = int(r.chunk_id[1:])
        assert r.centroid_idx == exact[i].argmin()
        assert abs(r.centroid_distance - exact[i].min()) < 1e-9
    assert len(got) == 3000


def test_odd_vectors_are_set_aside(spark):
    rows = [("a", [1.0, 2.0]), ("b", [1.0]), ("c", None), ("d", [1.0, None]), ("e", [0.0, 1.0]), ("f", [1.0, float("inf")])]
    vectors = spark.createDataFrame(rows, DDL)
    centres = centroid_frame(spark, [[0, 1], [1, 2]])
    kept = {r.chunk_id: r.centroid_idx for r in assign_nearest(vectors, centres).collect()}
    assert kept == {"a": 1, "e": 0}
    rejected = {r.chunk_id: r.reason for r in dimension_rejects(vectors, 2).collect()}
    assert set(rejected) == {"b", "c", "d", "f"} and "missing" in rejected["d"]


def test_routing(spark):
    centres = centroid_frame(spark, [[0, 0], [2, 0], [0, 1]])
    queries = spark.createDataFrame([("q", [0.1, 0.0]), ("r", None)], "query_id string, embedding array<float>")
    rows = route(queries, centres, 2).collect()
    assert [(r.query_id, r.probe, r.centroid_idx) for r in sorted(rows, key=lambda r: r.probe)] == [
        ("q", 1, 0),
        ("q", 2, 2),
    ]
    assert route(queries, centres, 10).count() == 3


def test_centroid_checks(spark):
    with pytest.raises(ValueError):
        centroid_matrix(centroid_frame(spark, []))
    with pytest.raises(ValueError):
        centroid_matrix(centroid_frame(spark, [[1, 2], [1]]))


def test_assignment_runs_once_below_a_filter(spark):
    vectors = frame(spark, np.eye(4))
    assigned = assign_nearest(vectors, centroid_frame(spark, np.eye(4))).where("centroid_idx = 1")
    plan = assigned._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert [r.chunk_id for r in assigned.collect()] == ["v1"]


def test_group_means(spark):
    rows = [("a", 1, [1.0, 3.0]), ("b", 1, [3.0, 5.0]), ("c", 2, [7.0, 7.0]), ("d", 2, None)]
    data = spark.createDataFrame(rows, "chunk_id string, g int, embedding array<float>")
    found = {r.centroid_idx: r.centroid for r in group_centroids(data, "g").collect()}
    assert found == {1: [2.0, 4.0], 2: [7.0, 7.0]}


def test_training_finds_clusters_and_respects_limits(spark):
    rng = np.random.default_rng(3)
    means = np.array([[0, 0], [10, 0], [0, 10]])
    points = np.vstack([m + rng.normal(scale=0.1, size=(200, 2)) for m in means])
    centres = train_centroids(frame(spark, points), num_centroids=3)
    _, matrix = centroid_matrix(centres)
    assert all(np.linalg.norm(matrix - m, axis=1).min() < 0.2 for m in means)
    copies = frame(spark, np.vstack([np.tile([1.0, 2], (50, 1)), [[3, 4]]]))
    assert train_centroids(copies, num_centroids=30).count() == 2
    same = frame(spark, np.tile([1.0, 2], (9, 1)))
    assert [list(r.centroid) for r in train_centroids(same).collect()] == [[1.0, 2.0]]
    assert train_centroids(frame(spark, np.empty((0, 2)))).count() == 0


def test_sample_is_the_same_on_any_layout(spark):
    rows = spark.range(30000).selectExpr("cast(id as string) chunk_id")
    one = {r[0] for r in sample_rows(rows, "chunk_id", 50).collect()}
    two = {r[0] for r in sample_rows(rows.repartition(31), "chunk_id", 50).collect()}
    direct = rows.orderBy(F.md5(F.concat(F.lit("42:"), "chunk_id")), "chunk_id").limit(50)
    assert one == two == {r[0] for r in direct.collect()} and len(one) == 50
    assert one != {r[0] for r in sample_rows(rows, "chunk_id", 50, seed=7).collect()}
    assert sample_rows(rows, "chunk_id", 0).count() == 0
    assert sample_rows(rows.limit(5), "chunk_id", 50).count() == 5


def test_sample_of_copies_still_fills_up(spark):
    copies = spark.range(30000).selectExpr("if(id < 5, cast(id as string), 'same') chunk_id")
    assert sample_rows(copies, "chunk_id", 2000).count() == 2000


def test_labels_are_dense_in_a_hot_group(spark):
    rows = spark.range(20000).selectExpr(
        "cast(id as string) chunk_id", "cast(if(id % 3 < 2, 0, id % 7) as int) centroid_idx"
    )
    for per_bin in (50, 50_000):
        labelled = dense_labels(rows, rows_per_bin=per_bin)
        checks = labelled.groupBy("centroid_idx").agg(
            F.count("*").alias("n"), F.countDistinct("label").alias("d"),
            F.min("label").alias("lo"), F.max("label").alias("hi"))
        assert all(r.d == r.n and r.lo == 0 and r.hi == r.n - 1 for r in checks.collect())
        assert labelled.count() == 20000
    order = dense_labels(rows, rows_per_bin=50).where("centroid_idx = 0").orderBy("label")
    from hashlib import md5

    ids = [r.chunk_id for r in order.collect()]
    assert ids == sorted(ids, key=lambda i: (md5(i.encode()).hexdigest(), i))


def test_labels_sort_one_bin_at_a_time(spark):
    rows = spark.range(20000).selectExpr("cast(id as string) chunk_id", "int(id % 20 = 0) centroid_idx")
    labelled = dense_labels(rows, rows_per_bin=50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = labelled.withColumn("p", F.spark_partition_id()).groupBy("p")
        sizes = placed.agg(F.count("*").alias("count"), F.max("label")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    # 20000 rows at 50 per bin: 400 partitions, more than the session's 8.
    assert len(sizes) > 100 and max(r["count"] for r in sizes) < 1000
    plan = labelled._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.splitlines() if "Exchange" in line and "400" in line]
    assert len(wide) == 2


def test_column_functions(spark):
    rows = [([3.0, 4.0], [0.0, 0.0]), ([1.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([1.0], [1.0, 2.0]), ([2.0], [3.0])]
    data = spark.createDataFrame(rows, "a array<float>, b array<float>")
    pair = F.col("a"), F.col("b")
    got = data.select(l2_distance(*pair), inner_product(*pair), cosine(*pair)).collect()
    assert tuple(got[0]) == (5.0, 0.0, 0.0)
    assert got[1][0] == 1.0 and got[1][1] == 1.0 and abs(got[1][2] - 0.5**0.5) < 1e-12
    assert tuple(got[2]) == tuple(got[3]) == (None, None, None)
    assert tuple(got[4]) == (1.0, 6.0, 1.0)


def test_any_model_plugs_in(spark):
    class Counting:
        """A model whose vectors hold the text's length and a constant."""

        def __call__(self, texts):
            assert len(texts) <= 4
            return np.array([[len(t.as_py()), 1.0] for t in texts])

    data = spark.createDataFrame([(i, None if i == 3 else "x" * i) for i in range(20)], "i int, t string")
    rows = data.withColumn("e", embed_column(F.col("t"), Counting, "counting", 4)).collect()
    for r in rows:
        assert r.e == (None if r.i == 3 else [float(r.i), 1.0])


def test_hashing_embedder(spark):
    texts = ["Same words", "words, SAME!", "other", "", "... !!"]
    data = spark.createDataFrame([(t,) for t in texts], "t string")
    found = {r.t: np.array(r.e) for r in data.withColumn("e", embed_column(F.col("t"))).collect()}
    assert np.array_equal(found["Same words"], found["words, SAME!"])
    assert abs(np.linalg.norm(found["other"]) - 1) < 1e-6
    assert not found[""].any() and not found["... !!"].any()
    model = HashingEmbedder(8)
    import pyarrow as pa

    assert model(pa.array(["a b a"])).shape == (1, 8)


def test_more_centroids_than_samples_is_an_error(spark):
    points = frame(spark, np.random.default_rng(1).normal(size=(400, 2)))
    with pytest.raises(ValueError):
        train_centroids(points, num_centroids=300, max_samples=100)
    assert train_centroids(points, num_centroids=300).count() == 300


def test_null_keys_are_never_sampled(spark):
    rows = [(None, [1.0])] * 50 + [(f"v{i}", [1.0]) for i in range(60)]
    small = sample_rows(spark.createDataFrame(rows, DDL), "chunk_id", 80).collect()
    assert len(small) == 60 and all(r.chunk_id for r in small)
    many = spark.range(20_000).selectExpr("if(id % 2 = 0, null, concat('v', id)) chunk_id", "array(1f) embedding")
    assert all(r.chunk_id for r in sample_rows(many, "chunk_id", 80).collect())


def test_lloyd_steps(spark):
    rng = np.random.default_rng(8)
    matrix = np.concatenate([rng.normal(c, 0.3, size=(50, 2)) for c in ((0, 0), (9, 0), (0, 9))])
    got = lloyd_steps(frame(spark, matrix), 3, 4).orderBy("centroid_idx").collect()
    first = [r.chunk_id for r in sample_rows(frame(spark, matrix), "chunk_id", 3).collect()]
    first.sort(key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
    vectors = matrix.astype(np.float32).astype(float)
    centres = np.array([vectors[int(i[1:])] for i in first])
    for _ in range(4):
        near = np.linalg.norm(vectors[:, None] - centres[None], axis=2).argmin(axis=1)
        centres = np.array([vectors[near == k].mean(axis=0) if (near == k).any() else centres[k] for k in range(3)])
    assert np.allclose([r.centroid for r in got], centres)


def test_tokens_of_the_embedder_are_runs_of_letters_and_digits():
    def plain(text, dim):
        counts = np.zeros(dim)
        for token in pc.split_pattern_regex(pa.array([text.lower()]), r"[^\p{L}\p{N}]+")[0].as_py():
            if token:
                counts[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim] += 1
        return counts / (np.linalg.norm(counts) or 1.0)

    odd = ["", " ", "a b", "é…ß „x“", "ée", "日本 語。abc_d-e", "\x00a\x00", "…", "ＡＢ½²", "\U0001f389x", "a" * 1000 + "…" + "b" * 70, "a-a–a—a"]
    for model in (HashingEmbedder(16), HashingEmbedder()):
        for texts in (pa.array(odd), pa.array(odd)[3:9], pa.array(odd)[:0], pa.array(odd, pa.large_string())):
            got = model(texts)
            assert got.shape == (len(texts), model.dim)
            for row, text in zip(got, texts.to_pylist()):
                assert np.allclose(row, plain(text, model.dim))


def test_a_bucket_is_computed_once(monkeypatch):
    model, asked = HashingEmbedder(), []
    bucket = model.bucket
    monkeypatch.setattr(model, "bucket", lambda token: asked.append(token) or bucket(token))
    for _ in range(3):
        model(pa.array(["one two", "two — drei über"]))
    assert sorted(asked) == ["drei", "one", "two", "über"]
