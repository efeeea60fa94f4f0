import numpy as np
import pytest
from pyspark.sql import functions as F

from passagelake.operators.search import search_passages, search_vectors
from passagelake.sources.index_store import (
    append_vectors,
    build_index,
    create_empty_index,
    finished_versions,
    open_index,
    write_centroids,
    write_index_metadata,
)
from test_vectors import centroid_frame

RNG = np.random.default_rng(11)
POINTS = RNG.normal(size=(600, 8)).astype(np.float32)


def passages(spark, points, start=0):
    rows = [
        (f"text {i}", f"v{i}", f"d{i // 3}", 6, [float(x) for x in p])
        for i, p in enumerate(points, start)
    ]
    return spark.createDataFrame(
        rows, "chunk string, chunk_id string, doc_id string, chunk_len int, embedding array<float>"
    )


def asked(spark):
    rows = [(f"q{i}", [float(x) for x in p]) for i, p in enumerate(POINTS[:9])]
    return spark.createDataFrame(rows, "query_id string, embedding array<float>")


def test_build_open_search(spark, tmp_path):
    path = str(tmp_path / "index")
    create_empty_index(spark, path)
    with pytest.raises(FileNotFoundError):
        open_index(spark, path)
    summary = build_index(passages(spark, POINTS), path, num_centroids=6).first()
    assert summary.status == "completed" and summary.num_shards == len(summary.shards) <= 6
    assert sum(s.num_vectors for s in summary.shards) == 600
    index = open_index(spark, path)
    row = finished_versions(spark, path).first()
    assert (row.distance_metric, row.shard_assignment_method) == ("l2", "argmin_distance")
    assert (row.shard_prefix, row.shards_path, row.max_shard_size) == ("shard_", "shards/", 50_000)
    labels = index.vectors().groupBy("centroid_idx").agg(
        F.count("*").alias("n"), F.max("label").alias("m"), F.count_distinct("label").alias("d")
    )
    assert all(r.m == r.n - 1 and r.d == r.n for r in labels.collect())
    exact = index.search(asked(spark), k=3, nprobe=6)
    first = {r.query_id: r.chunk_id for r in exact.where("rank = 1").collect()}
    best = (POINTS[:9] @ POINTS.T).argmax(axis=1)
    assert first == {f"q{i}": f"v{j}" for i, j in enumerate(best)}
    meta = index.shard_metadata().orderBy("centroid_index").first()
    assert meta.embedding_dim == 8 and len(meta.centroid_vector) == 8 and not meta.over_limit
    assert meta.paths.vectors == f"{path}/shards/{meta.shard_id}/vectors"
    assert meta.created_at.endswith("Z")


def test_only_routed_shards_and_needed_columns_are_read(spark, tmp_path):
    path = str(tmp_path / "index")
    build_index(passages(spark, POINTS), path, num_centroids=6)
    index = open_index(spark, path)
    def scans(frame):
        spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
        try:
            plan = frame._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.maxMetadataStringLength")
        return [line for line in plan.splitlines() if "FileScan" in line and f"{path}/" in line]

    one = asked(spark).limit(1)
    (scan,) = scans(search_vectors(one, index.vectors(), index.centroids(), nprobe=2))
    assert "embedding:array" in scan
    assert "chunk:string" not in scan.split("ReadSchema")[1]
    assert "centroid_idx" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    (texts,) = scans(index.search(one, nprobe=2))
    assert "chunk:string" in texts and "embedding" not in texts.split("ReadSchema")[1]
    assert "centroid_idx" in texts.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "EqualTo(label" in texts.split("PushedFilters")[1]
    files = index.vectors([0, 1]).inputFiles()
    assert index.vectors([0, 1]).select("centroid_idx").distinct().count() == 2 and files
    assert index.vectors([77]).count() == 0
    many = index.search(asked(spark), k=30, nprobe=2)
    assert many.where("rank <= 3").select("query_id", "rank", "text").exceptAll(
        index.search(asked(spark), k=3, nprobe=2).select("query_id", "rank", "text")
    ).count() == 0


def test_hot_shard_is_written_by_many_tasks(spark, tmp_path):
    """A shard with most rows is cut into bins, which different tasks sort and write."""
    from passagelake.operators.centroids import assign_nearest
    from passagelake.operators.labels import dense_labels
    from passagelake.sources.index_store import write_vectors

    points = np.vstack([np.tile(POINTS[0], (900, 1)), POINTS[:20]])
    centres = centroid_frame(spark, POINTS[:4])
    assigned = assign_nearest(passages(spark, points), centres).drop("centroid_distance")
    path = str(tmp_path / "index")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_vectors(dense_labels(assigned, rows_per_bin=50), path, 1)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stored = spark.read.parquet(f"{path}/vectors/index_version=1")
    hot = stored.groupBy("centroid_idx").count().orderBy(F.desc("count")).first()
    assert hot["count"] >= 900
    assert len(stored.where(F.col("centroid_idx") == hot.centroid_idx)
               .select(F.input_file_name()).distinct().collect()) > 3
    rows = stored.where(F.col("centroid_idx") == hot.centroid_idx)
    assert sorted(r.label for r in rows.collect()) == list(range(hot["count"]))


def test_appending_twice_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "index")
    build_index(passages(spark, POINTS[:400]), path, centroids=centroid_frame(spark, POINTS[:5]))
    index = open_index(spark, path)
    more, rest = passages(spark, POINTS[400:500], 400), passages(spark, POINTS[500:], 500)
    append_vectors(more, index, 1)
    append_vectors(rest, index, 2)
    before = index.vectors().orderBy("chunk_id").collect()
    append_vectors(more, index, 1)
    append_vectors(rest, index, 2)
    assert index.vectors().orderBy("chunk_id").collect() == before and len(before) == 600
    labels = index.vectors().groupBy("centroid_idx").agg(
        F.count("*").alias("n"), F.max("label").alias("m"), F.count_distinct("label").alias("d")
    )
    assert all(r.m == r.n - 1 and r.d == r.n for r in labels.collect())
    sizes = {r.centroid_idx: r.num_vectors for r in index.shard_sizes().collect()}
    assert sizes == {r.centroid_idx: r.n for r in labels.collect()}
    with pytest.raises(ValueError):
        append_vectors(more, index, 0)


def test_rebuilding_makes_a_new_version(spark, tmp_path):
    path = str(tmp_path / "index")
    build_index(passages(spark, POINTS), path, num_centroids=4)
    old = open_index(spark, path)
    build_index(passages(spark, POINTS[:50]), path, num_centroids=2)
    new = open_index(spark, path)
    assert (old.version, new.version) == (1, 2)
    assert (old.vectors().count(), new.vectors().count()) == (600, 50)
    assert new.shard_metadata().count() <= 2


def test_nothing_to_index(spark, tmp_path):
    path = str(tmp_path / "index")
    summary = build_index(passages(spark, POINTS[:0]), path)
    assert summary.first().status == "empty" and finished_versions(spark, path).count() == 0
    none = passages(spark, POINTS[:2]).withColumn("embedding", F.lit(None).cast("array<float>"))
    assert build_index(none, path).first().status == "empty"


def test_centroids_are_kept_when_none_are_given(spark, tmp_path):
    path = str(tmp_path / "index")
    write_centroids(spark, path, 1)
    write_index_metadata(spark, path, 1, 0)
    index = open_index(spark, path)
    assert index.centroids().count() == 0 and index.vectors().count() == 0
    write_centroids(spark, path, 1, centroid_frame(spark, POINTS[:3]))
    write_centroids(spark, path, 1)
    assert index.centroids().count() == 3
    found = search_passages(asked(spark), index.vectors(), index.centroids())
    assert found.count() == 0


def test_index_from_a_topic(spark, tmp_path):
    from passagelake.sources.index_store import build_index_from_topic
    from passagelake.sources.topics import EMBEDDED_FIELDS, publish, to_messages

    topic = str(tmp_path / "topic")
    publish(to_messages(passages(spark, POINTS), EMBEDDED_FIELDS), topic)
    publish(spark.createDataFrame([("{",), ("[]",)], "value string"), topic)
    build_index_from_topic(spark, topic, str(tmp_path / "all"), num_centroids=5)
    assert open_index(spark, str(tmp_path / "all")).vectors().count() == 600
    build_index_from_topic(spark, topic, str(tmp_path / "some"), 100, num_centroids=5)
    assert open_index(spark, str(tmp_path / "some")).vectors().count() == 100
    assert build_index_from_topic(spark, topic, str(tmp_path / "no"), 0).first().status == "empty"
