"""A topic's entries are read once each, wherever a reader stops."""

import pytest
from pyspark.sql import functions as F

from passagelake.sources import topic_log
from passagelake.sources.topic_log import acknowledge, acknowledged, backlog, log_ends, read_log, send, stream_log
from passagelake.streaming.stages import embed_topic


def words(spark, first, last):
    return spark.range(first, last).select(F.concat(F.lit("m"), F.col("id")).alias("value"))


def values(frame):
    return sorted(r.value for r in frame.collect())


def test_entries_and_offsets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topic_log, "SEGMENT_ROWS", 10)
    topic = str(tmp_path / "t")
    assert log_ends(topic) == {} and read_log(spark, topic).count() == 0
    assert [send(words(spark, 0, 45), topic), send(words(spark, 45, 50), topic)] == [0, 1]
    assert send(words(spark, 50, 60).coalesce(1), topic, "other") == 0
    assert send(words(spark, 0, 99), topic, "other", 0) == 0  # it is there already
    send(words(spark, 0, 0), topic, "none")
    assert log_ends(topic) == {"main": 2, "none": 1, "other": 1}
    everything = read_log(spark, topic)
    assert values(everything) == sorted(f"m{i}" for i in range(60))
    assert everything.select("sender", "entry", "position").distinct().count() == 60
    assert max(r["count"] for r in everything.groupBy(F.spark_partition_id()).count().collect()) <= 10
    assert values(read_log(spark, topic, {"main": 1}, {"main": 2})) == [f"m{i}" for i in range(45, 50)]
    assert read_log(spark, topic, limit=17).count() == 17
    assert read_log(spark, topic, limit=0).count() == 0
    first = read_log(spark, topic, limit=7).collect()
    assert sorted((r.entry, r.position) for r in first) == [(0, i) for i in range(7)]


def test_null_messages_and_names(spark, tmp_path):
    topic = str(tmp_path / "t")
    send(spark.createDataFrame([("a",), (None,), ("a",), ("",)], "value string"), topic)
    assert values(read_log(spark, topic)) == ["", "a", "a"]
    with pytest.raises(ValueError):
        send(words(spark, 0, 1), topic, "a/b")


def test_a_gap_ends_the_log(spark, tmp_path):
    topic = str(tmp_path / "t")
    send(words(spark, 0, 3), topic, "s", 1)
    assert log_ends(topic) == {"s": 0} and read_log(spark, topic).count() == 0
    send(words(spark, 3, 5), topic, "s", 0)
    assert values(read_log(spark, topic)) == [f"m{i}" for i in range(5)]


def drain(spark, topic, folder, fail=None):
    """Write each batch to its folder; ``fail`` is (batch, whether it fails after writing)."""

    def handle(batch, number):
        if fail == (number, False):
            raise RuntimeError("stopped before")
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        if fail == (number, True):
            raise RuntimeError("stopped after")

    stream = stream_log(spark, topic, "reader").writeStream.foreachBatch(handle)
    query = stream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination(120)
        return True
    except Exception:
        return False


@pytest.mark.parametrize("after", [False, True])
def test_a_stream_that_stops_anywhere_reads_each_message_once(spark, tmp_path, after):
    topic, folder = str(tmp_path / "t"), str(tmp_path / "f")
    for step in range(3):
        send(words(spark, 20 * step, 20 * step + 10), topic)
        send(words(spark, 20 * step + 10, 20 * step + 20), topic, f"s{step}")
        # Two batches a step: the one that stopped, and what was sent since.
        assert not drain(spark, topic, folder, (2 * step, after))
        send(words(spark, 1000 + step, 1001 + step), topic)  # sent between stop and restart
        # The stopped batch is run again with the messages that it had; the next run has those sent since.
        assert drain(spark, topic, folder)
        again = spark.read.parquet(f"{folder}/out/batch={2 * step}")
        assert values(again.where("value not like 'm100_'")) == sorted(f"m{i}" for i in range(20 * step, 20 * step + 20))
        assert drain(spark, topic, folder)
        out = spark.read.parquet(f"{folder}/out")
        expected = [*range(20 * step + 20), *range(1000, 1001 + step)]
        assert values(out) == sorted(f"m{i}" for i in expected)
    assert acknowledged(spark, topic, "reader")


def test_cursor_and_backlog(spark, tmp_path):
    topic = str(tmp_path / "t")
    send(words(spark, 0, 5), topic)
    send(words(spark, 5, 12), topic)
    acknowledge(spark, topic, "slow", {"main": 1})
    acknowledge(spark, topic, "slow", {"main": 0})  # never back
    rows = sorted(tuple(r) for r in backlog(spark, topic, ["fresh", "slow"]).collect())
    assert rows == [("fresh", 12, 12), ("slow", 12, 7)]


def test_stage_from_log_to_log(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    bodies = spark.range(30).select(F.to_json(F.struct(
        F.concat(F.lit("text "), "id").alias("chunk"), F.concat(F.lit("c"), "id").alias("chunk_id"),
        F.col("id").cast("string").alias("doc_id"), F.lit(6).alias("chunk_len"))).alias("value"))
    send(bodies, source)
    embed_topic(
        spark, stream_log(spark, source, "embedder"), lambda rows, batch: send(rows, target, "embedder", batch) and None,
        str(tmp_path / "dead"), str(tmp_path / "checkpoint"),
    ).awaitTermination(120)
    got = read_log(spark, target).select(F.get_json_object("value", "$.chunk_id").alias("value"))
    assert values(got) == sorted(f"c{i}" for i in range(30))
