"""Reports over runs and their passages."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed value: the rows of a preview.
PREVIEW_ROWS = 50


def chunk_counts(chunks: DataFrame, source_col: str = "source_file") -> DataFrame:
    """Chunks per source and in total (the row with a null source).

    Counts are made before the shuffle, so a source holding most rows is no burden.
    """
    return chunks.rollup(source_col).agg(F.count(F.lit(1)).alias("chunks"))


def embedding_preview(embedded: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows of an embedding run: chunk_id, doc_id, embedding_dimensions."""
    short = embedded.select(
        "chunk_id", "doc_id", F.size("embedding").alias("embedding_dimensions")
    )
    return short.orderBy("chunk_id").limit(rows)


def run_report(
    spark: SparkSession,
    status: str,
    start_time: datetime,
    end_time: datetime | None = None,
    chunks: DataFrame | None = None,
    error_message: str | None = None,
) -> DataFrame:
    """One row: is_running, status, start_time, end_time, total_chunks, duration_seconds, error."""
    total = (
        spark.range(1).select(F.lit(0).cast("bigint").alias("total_chunks"))
        if chunks is None
        else chunks.agg(F.count(F.lit(1)).alias("total_chunks"))
    )
    start, end = F.lit(start_time), F.lit(end_time).cast("timestamp")
    return total.select(
        (end.isNull()).alias("is_running"),
        F.lit(status).alias("status"),
        start.alias("start_time"),
        end.alias("end_time"),
        "total_chunks",
        (end.cast("double") - start.cast("double")).alias("duration_seconds"),
        F.lit(error_message).cast("string").alias("error_message"),
    )


class RunRecord:
    """Keeps what a job did as rows of a table: its start, and its end or error.

    ``with RunRecord(spark, folder, "chunking") as run: ... run.chunks = n``. A failed
    job is recorded and the error goes on. ``RunRecord.report`` reads the table.
    """

    SCHEMA = (
        "run_id string, job string, status string, start_time timestamp, end_time timestamp, "
        "total_chunks bigint, error_message string"
    )

    def __init__(self, spark: SparkSession, folder: str, job: str, clock=datetime.now):
        self.spark, self.folder, self.job, self.clock = spark, folder, job, clock
        self.run_id, self.chunks = uuid.uuid4().hex, 0

    def _write(self, status: str, end=None, error: str | None = None) -> None:
        row = (self.run_id, self.job, status, self.start, end, self.chunks, error)
        frame = self.spark.createDataFrame([row], self.SCHEMA)
        frame.coalesce(1).write.mode("append").parquet(self.folder)

    def __enter__(self) -> RunRecord:
        self.start = self.clock()
        self._write("running")
        return self

    def __exit__(self, kind, error, trace) -> None:
        message = None if kind is None else f"{kind.__name__}: {error}"
        self._write("completed" if kind is None else "failed", self.clock(), message)

    @staticmethod
    def report(spark: SparkSession, folder: str) -> DataFrame:
        """One row per run: is_running, status, start_time, end_time, total_chunks, duration_seconds, error_message."""
        rows = spark.read.schema(RunRecord.SCHEMA).parquet(folder)
        last = F.struct(F.col("end_time").isNotNull().alias("ended"), *[c for c in rows.columns if c != "run_id"])
        latest = rows.groupBy("run_id").agg(F.max(last).alias("r")).select("run_id", "r.*")
        return latest.select(
            "run_id",
            "job",
            (~F.col("ended")).alias("is_running"),
            "status",
            "start_time",
            "end_time",
            "total_chunks",
            (F.col("end_time").cast("double") - F.col("start_time").cast("double")).alias("duration_seconds"),
            "error_message",
        )
