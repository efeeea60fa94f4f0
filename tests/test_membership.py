"""The filter loses no stored key, and the check behind it is exact."""

import pytest
from pyspark.sql import functions as F

from passagelake.operators.membership import (
    _candidates,
    _near_candidates,
    add_to_filter,
    filter_length,
    mark_stored,
    read_filter,
)
from passagelake.session import reliable


def paths(spark, first, last):
    return spark.range(first, last).select(F.concat(F.lit("dir/"), F.col("id"), F.lit(".json")).alias("path"))


@pytest.mark.parametrize("broadcast_keys", [0, 10**6])
def test_same_rows_as_a_join(spark, tmp_path, broadcast_keys):
    folder, stored = str(tmp_path / "f"), reliable(paths(spark, 0, 4000))
    add_to_filter(stored, folder, 0)
    later = paths(spark, 4000, 5000)
    add_to_filter(later, folder, 1)
    add_to_filter(later, folder, 1)
    stored = reliable(stored.unionByName(later))
    rows = paths(spark, 3000, 9000)
    got = {r.path: r.already_stored for r in mark_stored(rows, stored, folder, broadcast_keys=broadcast_keys).collect()}
    assert got == {f"dir/{i}.json": i < 5000 for i in range(3000, 9000)}


def test_false_candidates_are_few_and_no_stored_key_is_lost(spark, tmp_path):
    folder = str(tmp_path / "f")
    add_to_filter(paths(spark, 0, 50_000), folder, expected_keys=50_000)
    marked = _candidates(paths(spark, 0, 150_000), "path", read_filter(spark, folder), filter_length(spark, folder))
    stored = F.regexp_extract("path", r"\d+", 0).cast("int") < 50_000
    counts = marked.agg(F.count_if(stored & F.col("_maybe")).alias("a"), F.count_if(~stored & F.col("_maybe")).alias("b")).first()
    assert counts.a == 50_000 and counts.b < 0.02 * 100_000


@pytest.mark.parametrize("broadcast_keys", [0, 10**6])
def test_the_store_is_not_shuffled(spark, broadcast_keys):
    stored = reliable(paths(spark, 0, 20_000)).select(F.col("path").alias("_key"))
    asked = reliable(paths(spark, 19_900, 20_000).select(F.col("path").alias("_key")))
    near = _near_candidates(stored, asked, 100, broadcast_keys)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert 100 <= near.count() <= 600


def test_odd_rows(spark, tmp_path):
    folder = str(tmp_path / "f")
    stored = spark.createDataFrame([("a", 1), (None, 2), ("a", 3), ("", 4)], "path string, _key int")
    with pytest.raises(ValueError):
        mark_stored(stored, stored, folder)
    add_to_filter(stored, folder)
    rows = spark.createDataFrame([("a", 1, 1), ("a", 1, 1), (None, 2, 2), ("", 3, 3), ("b", 4, 4)], "path string, word int, bits int")
    got = mark_stored(rows, stored, folder)
    assert got.columns == ["path", "word", "bits", "already_stored"]
    assert sorted((str(r.path), r.word, r.already_stored) for r in got.collect()) == [
        ("", 3, True), ("None", 2, False), ("a", 1, True), ("a", 1, True), ("b", 4, False),
    ]
    gone = mark_stored(rows, stored.where("path = ''"), folder)
    assert sorted(r.word for r in gone.where("already_stored").collect()) == [3]
    add_to_filter(rows.limit(0), str(tmp_path / "empty"))
    assert mark_stored(rows, rows, str(tmp_path / "empty")).where("already_stored").isEmpty()
    assert mark_stored(rows.limit(0), stored, folder).isEmpty()
