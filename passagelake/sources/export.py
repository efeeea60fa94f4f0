"""Exporting a corpus as gzipped JSON-lines shards of an exact size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: records per exported shard.
CHUNK_SIZE = 10_000

MAX_PARTITIONS = 200_000


def shard_file_name(shard: Column, split: str) -> Column:
    return F.format_string("%s-%05d", F.lit(split), shard)


def plan_shards(
    rows: DataFrame, chunk_size: int = CHUNK_SIZE, max_chunks: int | None = None
) -> DataFrame:
    """Add ``shard``: rows in ``position`` order, exactly ``chunk_size`` per shard.

    The last shard may be smaller; ``max_chunks`` stops after that many shards.
    """
    if chunk_size <= 0:
        raise ValueError("chunk_size must be positive")
    if max_chunks is not None and max_chunks <= 0:
        raise ValueError("max_chunks must be positive")
    planned = rows.withColumn("shard", F.floor(F.col("position") / chunk_size).cast("bigint"))
    return planned if max_chunks is None else planned.where(F.col("shard") < max_chunks)


def export_documents(
    rows: DataFrame,
    folder: str,
    split: str = "train",
    chunk_size: int = CHUNK_SIZE,
    max_chunks: int | None = None,
) -> None:
    """Write one gzipped JSON-lines file per shard, in ``position`` order.

    One shuffle, by ranges of shards: neighbouring shards go to one task, and shards
    are equal by construction, so every task writes about as many. Writing again
    replaces the earlier export.
    """
    planned = plan_shards(rows, chunk_size, max_chunks)
    last = planned.agg(F.max("shard")).first()[0]
    tasks = min(MAX_PARTITIONS, 1 + (last or 0))
    (
        planned.withColumn("shard_name", shard_file_name(F.col("shard"), split))
        .repartitionByRange(tasks, "shard")
        .sortWithinPartitions("shard_name", "position")
        .drop("shard", "position")
        .write.mode("overwrite")
        .partitionBy("shard_name")
        .option("compression", "gzip")
        .option("ignoreNullFields", False)
        .json(folder)
    )


def export_summary(
    planned: DataFrame, dataset_id: str, split: str, folder: str | None = None
) -> DataFrame:
    """One row: dataset_id, split, chunks_uploaded, documents_uploaded[, bytes_uploaded].

    Bytes are those of the files in ``folder``, taken from the file listing. Rows
    are counted per shard before anything is shuffled.
    """
    counts = planned.groupBy("shard").count().agg(
        F.count(F.lit(1)).alias("chunks_uploaded"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("documents_uploaded"),
    )
    summary = counts.select(
        F.lit(dataset_id).alias("dataset_id"),
        F.lit(split).alias("split"),
        "chunks_uploaded",
        "documents_uploaded",
    )
    if folder is None:
        return summary
    files = planned.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True)
    size = files.load(folder).agg(F.sum("length")).first()[0]
    return summary.withColumn("bytes_uploaded", F.lit(size or 0).cast("bigint"))
