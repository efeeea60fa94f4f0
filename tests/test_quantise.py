import os

import numpy as np
import pytest

from passagelake.operators.centroids import assign_nearest
from passagelake.operators.labels import dense_labels
from passagelake.operators.quantise import CODES, Codebooks, quantise, search_quantised, train_codebooks
from passagelake.operators.search import METRICS, recall_at_k, search_vectors
from passagelake.session import reliable
from passagelake.sources.index_store import append_vectors, build_index, open_index
from pyspark.sql import functions as F
from test_vectors import centroid_frame, frame


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(40, 32))
    vectors = (middles[rng.integers(0, 40, 3000)] + 0.5 * rng.normal(size=(3000, 32))).astype(np.float32)
    vectors[100:300] = vectors[0]  # copies
    vectors[7] = 0
    queries = (middles[rng.integers(0, 40, 50)] + 0.5 * rng.normal(size=(50, 32))).astype(np.float32)
    cf = centroid_frame(spark, np.concatenate([np.zeros((1, 32)), middles[:3]]))
    vf = reliable(dense_labels(reliable(assign_nearest(frame(spark, vectors).repartition(4), cf))))
    return frame(spark, queries, "q").withColumnRenamed("chunk_id", "query_id"), vf, cf, train_codebooks(vf, parts=8)


def test_bounds_hold_what_codes_stand_for(data):
    _, vectors, _, books = data
    assert [len(e) for e in books.entries] == [256] * 8
    rows = {(r.centroid_idx, r.label): np.array(r.embedding, dtype=float) for r in vectors.collect()}
    coded = quantise(vectors, books).collect()
    assert len(coded) == len(rows) == 3000
    for r in coded:
        vector = rows[r.centroid_idx, r.label]
        gap = np.linalg.norm(vector - books.decode(np.frombuffer(r.code, np.uint8)[None])[0])
        assert gap <= r.error <= gap * 1.001 + 1e-4 and r.length == pytest.approx(np.linalg.norm(vector), rel=1e-5)


@pytest.mark.parametrize("metric", METRICS)
def test_exact_search_by_codes_is_a_scan(data, metric):
    queries, vectors, centres, books = data
    codes = reliable(quantise(vectors, books))
    found = search_quantised(queries, codes, vectors, centres, books, k=6, nprobe=2, metric=metric, exact=True)
    scanned = search_vectors(queries, vectors, centres, k=6, nprobe=2, metric=metric)
    columns = ["query_id", "chunk_id", "centroid_idx", "score", "rank"]
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, scanned.select(columns).collect()))
    some = reliable(search_quantised(queries, codes, vectors, centres, books, k=6, nprobe=2, metric=metric, candidates=80))
    assert recall_at_k(some, scanned).first()["recall"] >= 0.95


def test_a_stored_index_reads_a_quarter_at_most(spark, data, tmp_path):
    queries, vectors, centres, _ = data
    embedded = vectors.select(
        F.concat(F.lit("text of "), "chunk_id").alias("chunk"), "chunk_id", F.lit("d").alias("doc_id"),
        F.lit(3).alias("chunk_len"), "embedding",
    )
    build_index(embedded, str(tmp_path / "i"), centroids=centres)
    index = open_index(spark, str(tmp_path / "i"))
    with pytest.raises(ValueError):
        index.codes()
    index.build_codes(parts=8)
    held = [f.split()[0] for f in CODES.split(", ")]
    assert set(held) == set(index.codes().columns)
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, n in os.walk(tmp_path / "i" / "codes") for f in n if f.endswith("parquet"))
    assert 4 * size < 3000 * 32 * 4
    found = index.search_codes(queries, nprobe=4, exact=True)
    scanned = search_vectors(queries, index.vectors(), centres, nprobe=4)
    assert recall_at_k(found, scanned).first()["recall"] == 1.0
    assert found.where("chunk <> concat('text of ', chunk_id)").isEmpty()
    append_vectors(embedded.limit(5), index, 1)
    with pytest.raises(ValueError):
        index.codes()


def test_few_vectors_gaps_and_nothing(spark, data):
    queries, vectors, centres, books = data
    few = reliable(vectors.where("chunk_id in ('v1', 'v2', 'v7')"))
    small = train_codebooks(few, parts=5)
    assert Codebooks.of(small.frame(spark)).edges == small.edges == [0, 7, 14, 20, 26, 32]
    codes = reliable(quantise(few, small))
    assert search_quantised(queries, codes, few, centres, small, k=5, nprobe=4).count() == 150
    odd = spark.createDataFrame([("a", [1.0]), ("b", None), ("c", [float("nan")] * 32)], "query_id string, embedding array<float>")
    assert search_quantised(odd, codes, few, centres, small).count() == 0
    assert quantise(vectors.where("false"), books).count() == 0
    with pytest.raises(ValueError):
        train_codebooks(vectors.where("false"))
