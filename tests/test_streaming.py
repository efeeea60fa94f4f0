import json

from pyspark.sql import functions as F

from passagelake.functions.embed import HashingEmbedder, embed_column
from passagelake.sources.index_store import compact_index, create_empty_index, open_index, write_centroids, write_index_metadata
from passagelake.sources.topics import receive, subscribe
from passagelake.streaming.stages import (
    embed_topic,
    index_topic,
    progress_report,
    read_dead_letters,
)
from test_vectors import centroid_frame

DIM = HashingEmbedder().dim


def send(spark, topic, numbers, extra=()):
    bodies = [
        json.dumps({"chunk": f"text number {n} of {n % 7}", "chunk_id": f"c{n}", "doc_id": f"00{n}"})
        for n in numbers
    ]
    frame = spark.createDataFrame([(b,) for b in [*bodies, *extra]], "value string")
    frame.repartition(3).write.mode("append").text(topic)


def run(spark, base, index):
    embed_topic(
        spark, f"{base}/in", f"{base}/out", f"{base}/dead", f"{base}/cp", max_files_per_trigger=2
    ).awaitTermination()
    index_topic(spark, f"{base}/out", index, f"{base}/dead2", f"{base}/cp2", 2).awaitTermination()


def test_streams_fill_the_index_once(spark, tmp_path):
    base = str(tmp_path)
    path = f"{base}/index"
    create_empty_index(spark, path)
    centres = [[1.0 if i == j else 0.0 for j in range(DIM)] for i in range(4)]
    write_centroids(spark, path, 1, centroid_frame(spark, centres))
    write_index_metadata(spark, path, 1, 4)
    index = open_index(spark, path)

    bad = ["{bad", "[1]", json.dumps({"chunk": "x", "chunk_id": "y"}), json.dumps({"doc_id": 1})]
    send(spark, f"{base}/in", range(60), bad)
    run(spark, base, index)
    assert index.vectors().count() == 60
    assert sorted(r.reason for r in read_dead_letters(spark, f"{base}/dead").collect()) == [
        "Invalid JSON",
        "Missing ids",
        "Schema validation failed",
    ]
    sums = progress_report(spark, f"{base}/cp").agg(
        *[F.sum(c) for c in ("messages", "accepted", "dropped", "dead_lettered")]
    )
    assert tuple(sums.first()) == (64, 60, 1, 2)
    assert progress_report(spark, f"{base}/cp2").agg(F.sum("accepted")).first()[0] == 60
    assert index.shard_metadata().agg(F.sum("num_vectors")).first()[0] == 60

    # A second run takes only what is new.
    send(spark, f"{base}/in", range(60, 100))
    run(spark, base, index)
    stored = index.vectors().select("chunk_id", "doc_id", "chunk", "chunk_len", "embedding")
    assert stored.count() == 100 == stored.select("chunk_id").distinct().count()
    assert receive(spark, f"{base}/out").count() == 100

    # Many small batches become one, with the same rows and labels.
    compact = compact_index(index)
    assert compact.version > index.version and open_index(spark, path).version == compact.version
    columns = ["centroid_idx", "label", "chunk_id", "doc_id", "chunk", "chunk_len", "embedding"]
    assert compact.vectors().select(columns).exceptAll(index.vectors().select(columns)).count() == 0
    assert compact.vectors().count() == 100
    assert {r.batch_id for r in compact.vectors().select("batch_id").distinct().collect()} == {0}

    # What went through the streams equals one batch over the same messages.
    batch = spark.range(100).select(
        F.format_string("c%d", "id").alias("chunk_id"),
        F.col("id").cast("string").alias("doc_id"),
        F.format_string("text number %d of %d", "id", F.col("id") % 7).alias("chunk"),
    ).select("*", F.length("chunk").alias("chunk_len"), embed_column(F.col("chunk")).alias("embedding"))
    assert stored.exceptAll(batch).count() == 0
    labels = index.vectors().groupBy("centroid_idx").agg(
        F.count("*").alias("n"), F.max("label").alias("m"), F.count_distinct("label").alias("d")
    )
    assert all(r.m == r.n - 1 and r.d == r.n for r in labels.collect())


def test_bad_vectors_are_dead_lettered(spark, tmp_path):
    base = str(tmp_path)
    path = f"{base}/index"
    create_empty_index(spark, path)
    write_centroids(spark, path, 1, centroid_frame(spark, [[0, 0], [1, 1]]))
    write_index_metadata(spark, path, 1, 2)
    good = {"chunk": "a", "chunk_id": "1", "doc_id": "2", "chunk_len": 1, "embedding": [1, 1]}
    rows = [json.dumps(good), json.dumps({**good, "embedding": None}), "{", json.dumps({**good, "embedding": [1]})]
    spark.createDataFrame([(r,) for r in rows], "value string").write.text(f"{base}/out")
    index = open_index(spark, path)
    index_topic(spark, f"{base}/out", index, f"{base}/dead", f"{base}/cp").awaitTermination()
    assert [r.centroid_idx for r in index.vectors().collect()] == [1]
    reasons = sorted(r.reason for r in read_dead_letters(spark, f"{base}/dead").collect())
    assert reasons == [
        "Invalid JSON",
        "Schema validation failed",
        "Vector length is not that of the centroids",
    ]


def test_no_message_stops_the_streams_or_merges_ids(spark, tmp_path):
    base = str(tmp_path)
    create_empty_index(spark, f"{base}/index")
    write_centroids(spark, f"{base}/index", 1, centroid_frame(spark, [[0] * DIM, [1] * DIM]))
    write_index_metadata(spark, f"{base}/index", 1, 2)
    index = open_index(spark, f"{base}/index")
    good = {"chunk": "text", "chunk_id": "a", "doc_id": "d"}
    bad = [{**good, "chunk_len": 3_000_000_000}, {**good, "chunk_id": 1.7}, {**good, "chunk_id": 1.2}]
    large = [{**good, "chunk_id": 12345678901234567890123}, {**good, "chunk_id": 12345678901234567890124}]
    numbered = [{**good, "chunk_id": "z", "doc_id": -3.7}, {**good, "chunk_id": "y", "doc_id": 1e30}]
    rows = [(json.dumps(m),) for m in [*bad, *large, *numbered]]
    spark.createDataFrame(rows, "value string").write.text(f"{base}/in")
    huge = {**good, "chunk_id": "h", "chunk_len": 1, "embedding": [1e300] * DIM}
    tiny = {**good, "chunk_id": "t", "chunk_len": 2.5e9, "embedding": [1.0] * DIM}
    spark.createDataFrame([(json.dumps(m),) for m in (huge, tiny)], "value string").write.text(f"{base}/out")
    run(spark, base, index)
    assert read_dead_letters(spark, f"{base}/dead").count() == 3
    assert read_dead_letters(spark, f"{base}/dead2").count() == 2
    kept = {r.chunk_id: r.doc_id for r in index.vectors().collect()}
    assert kept == {
        "12345678901234567890123": "d", "12345678901234567890124": "d", "z": "-3", "y": "1" + "0" * 30,
    }


def test_any_stream_and_any_writer(spark, tmp_path):
    base = str(tmp_path)
    send(spark, f"{base}/in", range(10))
    # A frame as a broker gives it: binary values and more columns.
    frame = subscribe(spark, f"{base}/in").select(F.col("value").cast("binary").alias("value"), F.lit(1).alias("offset"))
    sent = []
    embed_topic(
        spark, frame, lambda messages, batch: sent.extend(r.value for r in messages.collect()), f"{base}/dead", f"{base}/cp"
    ).awaitTermination()
    assert sorted(json.loads(m)["chunk_id"] for m in sent) == sorted(f"c{n}" for n in range(10))
