import numpy as np
import pytest
from pyspark.sql import functions as F

from passagelake.operators import graph as graphs, search as searches
from passagelake.operators.bounds import bounded_topk, shard_balls
from passagelake.operators.centroids import assign_nearest
from passagelake.operators.graph import DEGREE, FAR_LINKS, build_graph, search_graph
from passagelake.operators.labels import dense_labels
from passagelake.operators.search import METRICS, recall_at_k, search_vectors
from passagelake.session import reliable
from passagelake.sources.index_store import append_vectors, build_index, open_index
from test_vectors import centroid_frame, frame


@pytest.fixture(scope="module")
def clusters(spark):
    """4,000 vectors of many tight clusters in four shards, one with over half of them; 60 queries near them."""
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(60, 12)) * 3
    vectors = (middles[rng.integers(0, 60, 4000)] + 0.4 * rng.normal(size=(4000, 12))).astype(np.float32)
    vectors[50:400] = vectors[0]  # copies
    centres = np.concatenate([np.zeros((1, 12)), middles[:3] * 1.5])
    queries = (middles[rng.integers(0, 60, 60)] + 0.4 * rng.normal(size=(60, 12))).astype(np.float32)
    cf = centroid_frame(spark, centres)
    vf = reliable(dense_labels(reliable(assign_nearest(frame(spark, vectors).repartition(5), cf))))
    return frame(spark, queries, "q").withColumnRenamed("chunk_id", "query_id"), vf, cf, vectors


@pytest.fixture(scope="module")
def graph(clusters):
    return reliable(build_graph(clusters[1]))


def test_lists_hold_the_nearest(clusters, graph):
    rows = graph.collect()
    shards = {}
    for r in rows:
        shards.setdefault(r.centroid_idx, {})[r.label] = r
    assert len(rows) == 4000 and max(len(s) for s in shards.values()) > 2000
    assert max(len(r.neighbours) for r in rows) <= 2 * DEGREE + FAR_LINKS
    found = wanted = 0
    for shard in shards.values():
        matrix = np.array([shard[i].embedding for i in range(len(shard))])
        for i in range(0, len(shard), 17):
            gaps = np.square(matrix - matrix[i]).sum(1)
            near = np.sort(np.delete(gaps, i))[:8]
            own = sorted(gaps[j] for j in shard[i].neighbours)[: len(near)]
            assert i not in shard[i].neighbours
            found += sum(a <= b + 1e-6 for a, b in zip(own, near))
            wanted += len(near)
    assert found / wanted > 0.95


@pytest.mark.parametrize("metric", METRICS)
def test_walks_find_what_a_scan_finds(clusters, graph, metric):
    queries, vectors, centres, _ = clusters
    walked = reliable(search_graph(queries, graph, centres, k=5, nprobe=2, metric=metric))
    scanned = reliable(search_vectors(queries, vectors, centres, k=5, nprobe=2, metric=metric))
    assert recall_at_k(walked, scanned).first()["recall"] >= 0.95
    both = walked.join(scanned.select("query_id", "chunk_id", F.col("score").alias("scanned")), ["query_id", "chunk_id"])
    assert both.where("score <> scanned").isEmpty()
    assert walked.groupBy("query_id").count().where("count <> 5").isEmpty()


def test_rounds_do_not_compare_all_pairs(clusters, monkeypatch):
    """Groups of the local joins are bounded, so a round compares a bounded number per vector."""
    seen = []
    real = graphs._nearest_first
    monkeypatch.setattr(graphs, "_nearest_first", lambda rows, *a: (seen.append(rows.count()), real(rows, *a))[1])
    build_graph(clusters[1], degree=6, rounds=2).count()
    assert max(seen) < 4000 * 13 * 6 and 4000 * 13 * 6 < 2000 * 2000 / 4


def test_small_and_empty_shards(spark):
    rows = [(0, i, f"c{i}", [float(i), 0.0]) for i in range(3)] + [(1, 0, "alone", [0.0, 9.0])]
    vectors = spark.createDataFrame(rows, "centroid_idx int, label bigint, chunk_id string, embedding array<float>")
    found = {(r.centroid_idx, r.label): r.neighbours for r in build_graph(vectors).collect()}
    assert found == {(0, 0): [1, 2], (0, 1): [0, 2], (0, 2): [0, 1], (1, 0): []}
    assert build_graph(vectors.where("false")).count() == 0
    centres = centroid_frame(spark, np.array([[0.0, 0.0], [0.0, 9.0], [50.0, 50.0]]))
    queries = spark.createDataFrame([("q", [0.1, 8.0])], "query_id string, embedding array<float>")
    hits = search_graph(queries, reliable(build_graph(vectors)), centres, k=4, nprobe=3, metric="l2").collect()
    assert [h.chunk_id for h in sorted(hits, key=lambda h: h["rank"])] == ["alone", "c0", "c1", "c2"]
    with pytest.raises(ValueError):
        search_graph(queries, vectors, centres, metric="other")


def test_a_stored_index_is_searched_by_its_graph(spark, clusters, tmp_path):
    queries, vectors, centres, _ = clusters
    embedded = vectors.select(
        F.concat(F.lit("text of "), "chunk_id").alias("chunk"), "chunk_id", F.lit("d").alias("doc_id"),
        F.lit(3).alias("chunk_len"), "embedding",
    )
    build_index(embedded, str(tmp_path / "i"), centroids=centres)
    index = open_index(spark, str(tmp_path / "i"))
    with pytest.raises(ValueError):
        index.graph()
    index.build_graph()
    found = reliable(index.search_graph(queries, k=3, nprobe=4))
    assert found.where("chunk <> concat('text of ', chunk_id)").isEmpty()
    scanned = search_vectors(queries, index.vectors(), centres, k=3, nprobe=4)
    assert recall_at_k(found, scanned).first()["recall"] >= 0.95
    append_vectors(embedded.limit(5), index, 1)
    with pytest.raises(ValueError):
        index.graph()


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize("block", [25, 1000])
def test_bounds_lose_nothing_and_open_few(spark, clusters, metric, block):
    queries, vectors, _, matrix = clusters
    middles = matrix[np.random.default_rng(1).choice(len(matrix), 40, replace=False)].astype(float)
    centres = centroid_frame(spark, middles)
    shards = reliable(assign_nearest(vectors.drop("centroid_idx", "centroid_distance", "label"), centres))
    hits, opened = bounded_topk(queries, shards, centres, k=4, metric=metric, block_queries=block)
    exact = search_vectors(queries, shards, centres, k=4, nprobe=1000, metric=metric)
    columns = ["query_id", "chunk_id", "centroid_idx", "score", "rank"]
    assert sorted(map(tuple, hits.select(columns).collect())) == sorted(map(tuple, exact.select(columns).collect()))
    counts = [r.shards_opened for r in opened.collect()]
    there = shards.select("centroid_idx").distinct().count()
    assert len(counts) == 60 and np.mean(counts) < (0.4 if metric == "l2" else 0.8) * there


def test_bounds_with_gaps_and_nothing(spark, clusters):
    queries, vectors, centres, _ = clusters
    odd = spark.createDataFrame([("a", [1.0]), ("b", None), ("c", [float("nan")] * 12)], "query_id string, embedding array<float>")
    hits, opened = bounded_topk(odd, vectors, centres)
    assert hits.count() == opened.count() == 0
    hits, _ = bounded_topk(queries, vectors.where("false"), centres)
    assert hits.count() == 0
    stored = reliable(shard_balls(vectors, centres))
    few, _ = bounded_topk(queries.limit(2), vectors.where("chunk_id in ('v1', 'v2')"), centres, k=5, balls=stored)
    assert few.count() == 4


def test_many_queries_pass_by_in_blocks_and_no_vector_is_shuffled(clusters, monkeypatch):
    queries, vectors, centres, _ = clusters
    plans = []
    real = searches.scan_routed

    def kept(*arguments):
        found = real(*arguments)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(searches, "scan_routed", kept)
    blocks = reliable(search_vectors(queries, vectors, centres, k=5, broadcast_numbers=12 * 3 * 9))
    assert len(plans) > 5 and not any("Exchange" in p for p in plans)
    whole = search_vectors(queries, vectors, centres, k=5)
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, whole.select(blocks.columns).collect()))
