"""Streams between topics and the index, safe to restart at any point.

Both stages read their topic once and write one folder per micro-batch; a batch
that is run again replaces what it wrote, so every message counts once. Each batch
also leaves a row of its numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from passagelake.functions.embed import HashingEmbedder, embed_column
from passagelake.operators.centroids import centroid_matrix, dimension_rejects
from passagelake.operators.validation import (
    dead_letters,
    prepare_for_embedding,
    validate_embedded,
)
from passagelake.schemas import DEAD_LETTER
from passagelake.sources.index_store import VectorIndex, append_vectors
from passagelake.sources.topics import EMBEDDED_FIELDS, subscribe, to_messages

PROGRESS = (
    "batch_id bigint, finished timestamp, messages bigint, accepted bigint, dropped bigint, dead_lettered bigint"
)
MISSING_IDS = "Missing ids"


def _trigger(every: str | None) -> dict:
    return {"processingTime": every} if every else {"availableNow": True}


def _stream(spark: SparkSession, source: str | DataFrame, max_files_per_trigger: int) -> DataFrame:
    """A topic folder as a stream, or any streaming frame with a column ``value`` (Kafka's, cast to text)."""
    if isinstance(source, DataFrame):
        return source.select(F.col("value").cast("string").alias("value"))
    return subscribe(spark, source, max_files_per_trigger)


def _note(counts: DataFrame, batch_id: int, folder: str) -> None:
    """Keep the numbers of a batch; the batch run again replaces them."""
    row = counts.select(
        F.lit(batch_id).cast("bigint").alias("batch_id"), F.current_timestamp().alias("finished"), *counts.columns
    )
    row.coalesce(1).write.mode("overwrite").parquet(f"{folder}/progress/batch={batch_id}")


def embed_topic(
    spark: SparkSession,
    source: str | DataFrame,
    target: str | Callable[[DataFrame, int], None],
    dead_letter_folder: str,
    checkpoint: str,
    factory: Callable = HashingEmbedder,
    model_key: str | None = None,
    max_files_per_trigger: int = 64,
    normalize_numeric_ids: bool = True,
    every: str | None = None,
) -> StreamingQuery:
    """Drain a topic of chunks: validate, embed, publish; bad messages are set aside.

    ``target`` is a topic folder, or a function of (messages, batch id) that sends them
    elsewhere. Rejected messages and those dropped for missing ids go to the dead
    letters with their reason. Without ``every`` the stream stops when the topic is
    empty; with it, it keeps running at that interval. The model runs once per message.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        prepared = prepare_for_embedding(batch, normalize_numeric_ids)
        # Messages that are embedded need not be kept as they came.
        prepared = prepared.withColumn("value", F.when(~F.col("has_ids"), F.col("value"))).persist()
        try:
            embedded = prepared.where("has_ids").withColumn(
                "embedding", embed_column(F.col("chunk"), factory, model_key)
            )
            messages = to_messages(embedded, EMBEDDED_FIELDS)
            if callable(target):
                target(messages, batch_id)
            else:
                messages.write.mode("overwrite").text(f"{target}/batch={batch_id}")
            without = prepared.where("has_text and not has_ids").select("value", F.lit(MISSING_IDS).alias("reason"))
            rejected = dead_letters(prepared).unionByName(without)
            rejected.write.mode("overwrite").parquet(f"{dead_letter_folder}/batch={batch_id}")
            counts = prepared.agg(
                F.count(F.lit(1)).alias("messages"),
                F.count_if("has_ids").alias("accepted"),
                F.count_if(F.col("has_text") & ~F.col("has_ids")).alias("dropped"),
                F.count("reason").alias("dead_lettered"),
            )
            _note(counts, batch_id, checkpoint)
        finally:
            prepared.unpersist()

    return (
        _stream(spark, source, max_files_per_trigger).writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{checkpoint}/stream").trigger(**_trigger(every)).start()
    )


def index_topic(
    spark: SparkSession,
    source: str | DataFrame,
    index: VectorIndex,
    dead_letter_folder: str,
    checkpoint: str,
    max_files_per_trigger: int = 64,
    every: str | None = None,
) -> StreamingQuery:
    """Append a topic of embedded chunks to an index, as new batches of its shards.

    Messages that fail validation, or whose vector does not fit the centroids, are
    set aside with the reason.
    """
    dim = centroid_matrix(index.centroids())[1].shape[1]

    def handle(batch: DataFrame, batch_id: int) -> None:
        # The message is kept with those that may be set aside.
        fits = F.col("reason").isNull() & (F.size("embedding") == dim)
        checked = validate_embedded(batch).withColumn("value", F.when(~fits, F.col("value"))).persist()
        try:
            good = checked.where(F.col("reason").isNull()).drop("reason")
            append_vectors(good, index, batch_id + 1)
            unfit = dimension_rejects(good, dim).select("value", "reason")
            rejected = dead_letters(checked).unionByName(unfit)
            rejected.write.mode("overwrite").parquet(f"{dead_letter_folder}/batch={batch_id}")
            kept = spark.read.schema(DEAD_LETTER).parquet(f"{dead_letter_folder}/batch={batch_id}")
            set_aside = kept.agg(F.count(F.lit(1)).alias("dead_lettered"))
            # Two rows of counts.
            counts = checked.agg(F.count(F.lit(1)).alias("messages")).join(F.broadcast(set_aside)).select(
                "messages",
                (F.col("messages") - F.col("dead_lettered")).alias("accepted"),
                F.lit(0).cast("bigint").alias("dropped"),
                "dead_lettered",
            )
            _note(counts, batch_id, checkpoint)
        finally:
            checked.unpersist()

    return (
        _stream(spark, source, max_files_per_trigger).writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{checkpoint}/stream").trigger(**_trigger(every)).start()
    )


def read_dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(DEAD_LETTER).parquet(folder).select("value", "reason")


def progress_report(spark: SparkSession, checkpoint: str) -> DataFrame:
    """One row for every micro-batch that the stage with this checkpoint folder has run, see PROGRESS."""
    rows = spark.read.schema(PROGRESS).option("recursiveFileLookup", True).parquet(f"{checkpoint}/progress")
    return rows.select("batch_id", "finished", "messages", "accepted", "dropped", "dead_lettered")
