import pytest
from pyspark.sql import functions as F

from passagelake.sources.deliveries import NOT_SETTLED, dead_messages, deliver, delivery_status
from passagelake.sources.topics import publish, topic_statistics


def busy_until(delivery):
    """Fails words of w until their delivery of that number; always words of x; forgets words of y; cannot pass on z."""

    def handle(batch):
        first = F.substring("value", 1, 1)
        error = (
            F.when((first == "w") & (F.col("delivery") < delivery), "Busy").when(first == "x", "Bad").when(first == "z", "Away")
        )
        return batch.where(first != "y").select("message_id", error.alias("error"), (first == "z").alias("transfer"))

    return handle


@pytest.fixture
def topic(spark, tmp_path):
    words = ["a", "a", "b", "w1", "w2", "x1", "y1", "z1", "z1"]
    publish(spark.createDataFrame([(w,) for w in words], "value string"), str(tmp_path / "topic"))
    return str(tmp_path / "topic")


def by_value(spark, folder, status):
    inbox = spark.read.parquet(f"{folder}/inbox")
    return sorted(tuple(r) for r in inbox.join(status, "message_id").select("value", "status", "deliveries", "error").collect())


def test_messages_are_tried_again_up_to_the_limit(spark, topic, tmp_path):
    folder = str(tmp_path / "d")
    status = deliver(spark, topic, folder, busy_until(3), max_deliveries=4)
    assert by_value(spark, folder, status) == [
        ("a", "completed", 1, None), ("a", "completed", 1, None), ("b", "completed", 1, None),
        ("w1", "completed", 3, None), ("w2", "completed", 3, None), ("x1", "dead-lettered", 4, "Bad"),
        ("y1", "dead-lettered", 4, NOT_SETTLED), ("z1", "transfer-dead-lettered", 4, "Away"),
        ("z1", "transfer-dead-lettered", 4, "Away"),
    ]
    assert sorted(r.value for r in dead_messages(spark, folder, 4).collect()) == ["x1", "y1", "z1", "z1"]
    left = status.where("status <> 'completed'").withColumn("subscription", F.lit("s"))
    row = topic_statistics(left).where("subscription is null").first()
    assert (row.active_messages, row.dead_letter_messages, row.transfer_dead_letter_messages) == (0, 2, 2)


@pytest.mark.parametrize("stop", [1, 2, 3])
def test_a_job_that_stops_goes_on_with_its_round(spark, topic, tmp_path, stop):
    folder, seen = str(tmp_path / "d"), []
    inner = busy_until(3)

    def handle(batch):
        number = batch.select("delivery").first()[0]
        seen.append((number, batch.count()))
        if len(seen) == stop:
            raise RuntimeError("the job is gone")
        return inner(batch)

    with pytest.raises(RuntimeError):
        deliver(spark, topic, folder, handle, max_deliveries=4)
    active = delivery_status(spark, folder, 4).where("status = 'active'").count()
    assert active == (9, 6, 6)[stop - 1]
    publish(spark.createDataFrame([("late",)], "value string"), topic)  # belongs to another drain
    status = deliver(spark, topic, folder, handle, max_deliveries=4)
    whole = deliver(spark, topic, str(tmp_path / "whole"), inner, max_deliveries=4)
    assert by_value(spark, folder, status) == [r for r in by_value(spark, str(tmp_path / "whole"), whole) if r[0] != "late"]
    again = seen[stop - 1]
    assert seen.count(again) == 2 and all(seen.count(s) == 1 for s in seen if s != again)
    before = len(seen)
    deliver(spark, topic, folder, handle, max_deliveries=4)
    assert len(seen) == before


def test_limits_and_an_empty_topic(spark, topic, tmp_path):
    with pytest.raises(ValueError):
        deliver(spark, topic, str(tmp_path / "d"), busy_until(1), max_deliveries=0)
    once = deliver(spark, topic, str(tmp_path / "once"), lambda batch: batch.select("message_id", F.lit("no").alias("error")), 1)
    assert once.where("status = 'dead-lettered' and deliveries = 1").count() == 9
    publish(spark.createDataFrame([], "value string"), str(tmp_path / "empty"))
    assert deliver(spark, str(tmp_path / "empty"), str(tmp_path / "e"), busy_until(1)).count() == 0
