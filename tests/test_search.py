import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from passagelake.operators.centroids import assign_nearest, route
from passagelake.operators.search import (
    attach_passages,
    candidate_hits,
    recall_at_k,
    search_passages,
    search_responses,
    search_vectors,
    shard_topk,
    trim_copies,
)
from test_vectors import centroid_frame, frame


def scores(queries, vectors, metric):
    queries, vectors = queries.astype(np.float64), vectors.astype(np.float64)
    if metric == "l2":
        return 1 - np.square(queries[:, None] - vectors[None]).sum(axis=2)
    unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    found = unit @ vectors.T
    return found / np.linalg.norm(vectors, axis=1) if metric == "cosine" else found


def brute(queries, vectors, centres, k, nprobe, metric="inner", per_shard=False):
    shard = np.linalg.norm(vectors[:, None].astype(float) - centres[None], axis=2).argmin(axis=1)
    dist = np.linalg.norm(queries[:, None].astype(float) - centres[None], axis=2)
    all_scores = np.round(scores(queries, vectors, metric), 9)
    best = {}
    for q in range(len(queries)):
        routed = np.argsort(dist[q], kind="stable")[:nprobe]
        groups = [[c] for c in routed] if per_shard else [list(routed)]
        for group in groups:
            rows = [i for i in range(len(vectors)) if shard[i] in group]
            rows.sort(key=lambda i: (-all_scores[q, i], f"v{i}"))
            for rank, i in enumerate(rows[:k], 1):
                best[(f"q{q}", f"v{i}")] = (rank, all_scores[q, i])
    return best


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(800, 12)).astype(np.float32)
    vectors[100:400] = vectors[0]  # more than a third are copies of one vector
    queries = rng.normal(size=(40, 12)).astype(np.float32)
    queries[0] = vectors[0]
    centres = rng.normal(size=(7, 12))
    cf = centroid_frame(spark, centres)
    vf = assign_nearest(frame(spark, vectors).repartition(6), cf).persist()
    qf = frame(spark, queries, "q").withColumnRenamed("chunk_id", "query_id")
    return queries, vectors, centres, qf, vf, cf


def as_dict(rows):
    return {(r.query_id, r.chunk_id): (r["rank"], round(r.score, 9)) for r in rows.collect()}


@pytest.mark.parametrize("metric", ["inner", "cosine", "l2"])
@pytest.mark.parametrize("limit", [10**9, 0])
def test_both_plans_match_brute_force(data, metric, limit):
    queries, vectors, centres, qf, vf, cf = data
    for k, nprobe in ((3, 3), (10, 1)):
        found = search_vectors(qf, vf, cf, k, nprobe=nprobe, metric=metric, broadcast_numbers=limit)
        wanted = brute(queries, vectors, centres, k, nprobe, metric)
        got = as_dict(found)
        assert got.keys() == wanted.keys()
        for key, (rank, score) in wanted.items():
            assert got[key][0] == rank and abs(got[key][1] - score) < 2e-9


@pytest.mark.parametrize("limit", [10**9, 0])
def test_top_of_each_shard(data, limit):
    queries, vectors, centres, qf, vf, cf = data
    got = as_dict(shard_topk(qf, vf, cf, 5, broadcast_numbers=limit))
    assert got.keys() == brute(queries, vectors, centres, 5, 3, per_shard=True).keys()


def test_probing_everything_is_exact(data):
    queries, vectors, centres, qf, vf, cf = data
    exact = search_vectors(qf, vf, cf, 3, nprobe=7)
    wanted = np.round(scores(queries, vectors, "inner"), 9)
    for q in range(len(queries)):
        rows = sorted(range(len(vectors)), key=lambda i: (-wanted[q, i], f"v{i}"))[:3]
        got = exact.where(F.col("query_id") == f"q{q}").orderBy("rank").collect()
        assert [r.chunk_id for r in got] == [f"v{i}" for i in rows]
        if q > 5:
            break
    assert recall_at_k(exact, exact).first().recall == 1.0
    routed = recall_at_k(search_vectors(qf, vf, cf, 3, nprobe=2), exact).first()
    assert routed.queries == 40 and 0 < routed.recall < 1


def test_large_query_sets_keep_groups_bounded(data, spark, monkeypatch):
    """Tiny pieces and blocks: every vector still meets every query of its shard once."""
    from passagelake.operators import search

    queries, vectors, centres, qf, vf, cf = data
    monkeypatch.setattr(search, "PIECE_NUMBERS", 1)
    monkeypatch.setattr(search, "BLOCK_QUERIES", 3)
    got = as_dict(search_vectors(qf, vf, cf, 4, broadcast_numbers=0))
    assert got.keys() == brute(queries, vectors, centres, 4, 3).keys()


def test_a_task_returns_only_its_best(data):
    _, _, _, qf, vf, cf = data
    hits, asked = candidate_hits(qf, vf.coalesce(1), cf, 3)
    assert asked == 40 and hits.count() <= 40 * 3


def test_copies_are_trimmed_to_the_smallest_ids():
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(50, 3)).astype(np.float32)
    vectors[10:30] = vectors[2]
    vectors[40:43] = vectors[5]
    ids = pd.Series([f"v{i:02d}" for i in rng.permutation(50)])
    kept = trim_copies(vectors, ids, 3)
    copies = [2, *range(10, 30)]
    assert sorted(ids[copies][kept[copies]]) == sorted(ids[copies])[:3]
    others = [i for i in range(50) if i not in copies and i not in (5, 40, 41, 42)]
    assert kept[others].all() and kept[[5, 40, 41, 42]].sum() == 3


def test_missing_shards_and_odd_queries(data, spark):
    queries, vectors, centres, qf, vf, cf = data
    empty = vf.where("centroid_idx = 99")
    assert search_vectors(qf, empty, cf).count() == 0
    odd = spark.createDataFrame([("n", None), ("s", [1.0])], "query_id string, embedding array<float>")
    assert search_vectors(odd, vf, cf).count() == 0
    mixed = search_vectors(odd.unionByName(qf), vf, cf)
    assert mixed.exceptAll(search_vectors(qf, vf, cf)).count() == 0
    zero = spark.createDataFrame([("z", [0.0] * 12)], "query_id string, embedding array<float>")
    assert [r.score for r in search_vectors(zero, vf, cf).collect()] == [0.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        search_vectors(qf, vf, cf, metric="other")


def test_results_with_text(data, spark):
    _, _, _, qf, vf, cf = data
    stored = vf.selectExpr(
        "*", "concat('text of ', chunk_id) chunk", "concat('d', chunk_id) doc_id", "9 chunk_len"
    )
    results = search_passages(qf, stored, cf, 3)
    hits = search_vectors(qf, vf, cf, 3)
    assert results.count() == hits.count() == 120
    for r in results.collect():
        assert r.text == f"text of {r.chunk_id}" == r.metadata.chunk_text
        assert r.doc_id == f"d{r.chunk_id}" and r.metadata.chunk_len == 9
    partial = stored.where("chunk_id <> 'v0'")
    assert attach_passages(hits, partial).where("chunk_id = 'v0'").count() == 0
    extra = qf.unionByName(spark.createDataFrame([("none", None)], qf.schema))
    responses = {r.query_id: r for r in search_responses(extra, results).collect()}
    assert responses["none"].total_candidates == 0 and responses["none"].results == []
    assert [x["rank"] for x in responses["q1"].results] == [1, 2, 3]


def test_routed_shards_are_searched_only(data):
    queries, _, _, qf, vf, cf = data
    routed = {(r.query_id, r.centroid_idx) for r in route(qf, cf, 2).collect()}
    found = search_vectors(qf, vf, cf, 5, nprobe=2)
    assert {(r.query_id, r.centroid_idx) for r in found.collect()} <= routed
