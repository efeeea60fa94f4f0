"""Message topics as folders of JSON lines, read in batches or as streams.

Stages take a folder, or any streaming frame with a column ``value``, such as a
Kafka topic's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

# The topic names of the two stages.
INGESTION = "ingestion"
UPLOAD_INDEX = "upload-index"

CHUNK_FIELDS = ("chunk", "doc_id", "chunk_len", "chunk_id", "source_file", "created_at")
EMBEDDED_FIELDS = ("chunk", "chunk_id", "doc_id", "chunk_len", "embedding")


def to_messages(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """One JSON message per row, with nulls written out."""
    body = F.to_json(
        F.struct(*fields),
        {
            "ignoreNullFields": "false",
            "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'",
            "timeZone": "UTC",
        },
    )
    return rows.select(body.alias("value"))


def publish(messages: DataFrame, topic: str | None) -> bool:
    """Append messages to a topic folder; without a topic nothing is done."""
    if not topic:
        return False
    messages.select("value").write.mode("append").text(topic)
    return True


def receive(spark: SparkSession, topic: str, max_messages: int | None = None) -> DataFrame:
    """The messages of a topic as a batch, or the first ``max_messages`` by file and place in it."""
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True)
    messages = reader.text(topic)
    if max_messages is None:
        return messages.select("value")
    placed = messages.select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    # A bounded receive is for a few messages: one task takes the first of every split.
    return placed.orderBy("_file", "_block", "_row").limit(max(0, max_messages)).select("value")


def subscribe(spark: SparkSession, topic: str, max_files_per_trigger: int = 64) -> DataFrame:
    """The messages of a topic as a stream, a bounded number of files at a time."""
    return (
        spark.readStream.format("text")
        .schema("value string")
        .option("lineSep", "\n")
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .load(topic)
    )


def watch(
    spark: SparkSession, topic: str, checkpoint: str, pause: str = "2 seconds", length: int = 100
) -> DataStreamWriter:
    """A continuous reader that shows a preview of each chunk, pausing between batches."""
    value = F.try_parse_json("value")
    previews = subscribe(spark, topic).select(
        F.try_variant_get(value, "$.chunk_id", "string").alias("chunk_id"),
        F.substring(F.try_variant_get(value, "$.chunk", "string"), 1, length).alias("preview"),
    )
    return (
        previews.writeStream.format("console")
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=pause)
    )


def topic_statistics(messages: DataFrame) -> DataFrame:
    """Per subscription: active, dead-letter and transfer-dead-letter messages, and all.

    ``messages`` has subscription and status. ``total_messages`` of the row with a
    null subscription is the topic's total.
    """
    status = F.col("status")
    return messages.rollup("subscription").agg(
        F.count_if(status == "active").alias("active_messages"),
        F.count_if(status == "dead-lettered").alias("dead_letter_messages"),
        F.count_if(status == "transfer-dead-lettered").alias("transfer_dead_letter_messages"),
        F.count(F.lit(1)).alias("total_messages"),
    )
