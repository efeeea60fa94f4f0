"""Deliveries of a topic's messages: counted, tried again, set aside at a limit.

A message is delivered until it is completed, or until it has been delivered as often as
the limit says; then it is dead-lettered. Deliveries go in rounds, as jobs over all
messages that are still open. Each round leaves one row for every message it delivered, and
the next round is what the one before left open; so the state is a table, keyed by message,
and a job that stops goes on with the round it was in.

Layout below the folder::

    inbox/                 the messages as they were received, numbered once
    deliveries/round=N/    message_id, error, transfer
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from passagelake.sources.topics import receive

# Fixed value: deliveries before a message is set aside.
MAX_DELIVERIES = 10

INBOX = "message_id bigint, value string"
ROUND = "message_id bigint, error string, transfer boolean"
NOT_SETTLED = "Neither completed nor abandoned"


def _finished(spark: SparkSession, folder: str) -> bool:
    """Whether a job has written the folder to its end."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def _round(spark: SparkSession, folder: str, number: int) -> DataFrame:
    return spark.read.schema(ROUND).parquet(f"{folder}/deliveries/round={number}")


def open_inbox(spark: SparkSession, topic: str, folder: str) -> DataFrame:
    """The messages of a topic with their numbers, received once and then kept."""
    if not _finished(spark, f"{folder}/inbox"):
        numbered = receive(spark, topic).select(F.monotonically_increasing_id().alias("message_id"), "value")
        numbered.write.mode("overwrite").parquet(f"{folder}/inbox")
    return spark.read.schema(INBOX).parquet(f"{folder}/inbox")


def deliver(
    spark: SparkSession,
    topic: str,
    folder: str,
    handle: Callable[[DataFrame], DataFrame],
    max_deliveries: int = MAX_DELIVERIES,
) -> DataFrame:
    """Deliver a topic's messages until each is settled; returns ``delivery_status``.

    ``handle`` takes (message_id, value, delivery) and gives message_id, error, which is null for
    a completed message, and, if it wants, transfer, which says that passing the message on is
    what failed. A message it gives no row for is abandoned. It may see a message again
    whose round did not finish, so it should replace what it wrote. Equal messages are
    messages of their own; an empty topic has no rounds.
    """
    if max_deliveries < 1:
        raise ValueError("a message is delivered once at least")
    inbox = open_inbox(spark, topic, folder)
    for number in range(1, max_deliveries + 1):
        waiting = inbox
        if number > 1:
            left = _round(spark, folder, number - 1).where("error is not null").select("message_id")
            waiting = inbox.join(left, "message_id", "left_semi")
        if _finished(spark, f"{folder}/deliveries/round={number}"):
            continue
        if waiting.isEmpty():
            break
        found = handle(waiting.withColumn("delivery", F.lit(number)))
        transfer = F.col("transfer") if "transfer" in found.columns else F.lit(False)
        told = found.select("message_id", "error", transfer.alias("transfer"), F.lit(True).alias("_told"))
        settled = waiting.select("message_id").join(told, "message_id", "left").select(
            "message_id",
            F.when(F.col("_told").isNull(), NOT_SETTLED).otherwise(F.col("error")).alias("error"),
            F.coalesce("transfer", F.lit(False)).alias("transfer"),
        )
        settled.write.mode("overwrite").parquet(f"{folder}/deliveries/round={number}")
    return delivery_status(spark, folder, max_deliveries)


def delivery_status(spark: SparkSession, folder: str, max_deliveries: int = MAX_DELIVERIES) -> DataFrame:
    """message_id, status, deliveries, error of every message of the inbox.

    ``completed`` is settled; ``active`` waits for its next delivery; ``dead-lettered`` and
    ``transfer-dead-lettered`` have had their last. Only the last round of a message counts.
    """
    inbox = spark.read.schema(INBOX).parquet(f"{folder}/inbox").select("message_id")
    rounds = 0
    while rounds < max_deliveries and _finished(spark, f"{folder}/deliveries/round={rounds + 1}"):
        rounds += 1
    if not rounds:
        none = F.lit(None).cast("string").alias("error")
        return inbox.select("message_id", F.lit("active").alias("status"), F.lit(0).alias("deliveries"), none)
    # Open messages of a round are in the next one: the last row of each is found without a shuffle
    # of all rounds by message.
    parts = None
    for number in range(1, rounds + 1):
        rows = _round(spark, folder, number)
        ended = F.col("error").isNull() if number < rounds else F.lit(True)
        dead = F.when(F.col("transfer"), "transfer-dead-lettered").otherwise("dead-lettered")
        still = dead if number == max_deliveries else F.lit("active")
        part = rows.where(ended).select(
            "message_id",
            F.when(F.col("error").isNull(), "completed").otherwise(still).alias("status"),
            F.lit(number).alias("deliveries"),
            "error",
        )
        parts = part if parts is None else parts.unionByName(part)
    return parts


def dead_messages(spark: SparkSession, folder: str, max_deliveries: int = MAX_DELIVERIES) -> DataFrame:
    """value and reason of the messages that were set aside, as the stages' dead letters have them."""
    status = delivery_status(spark, folder, max_deliveries).where(F.col("status").endswith("dead-lettered"))
    inbox = spark.read.schema(INBOX).parquet(f"{folder}/inbox")
    return inbox.join(status, "message_id").select("value", F.col("error").alias("reason"))
