"""The shared scratch folder of a job."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_base(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    A local session that names none (a test) gets a local folder; on a cluster that
    would be another folder on every machine, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    base = base or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
    base = tempfile.mkdtemp(prefix="passagelake-")
    spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; never reused between runs."""
    return f"{checkpoint_base(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def reliable(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into a table in the shared folder and go on from there.

    The result no longer depends on what came before, so losing executors later
    costs a read and not a recomputation, and every reader sees the same rows.
    """
    folder = scratch_folder(df.sparkSession, "table")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder that this job made, with the file system Spark would read it by."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A scratch folder that is gone after the block: for results that are written out inside it.

    Rows that are computed lazily must not outlive the block.
    """
    folder = scratch_folder(spark, name)
    try:
        yield folder
    finally:
        remove_folder(spark, folder)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def recommended_settings(input_bytes: int, cores: int) -> dict[str, str]:
    """Session settings for an input of this size: about 128 MB per shuffle partition.

    Adaptive execution merges partitions that turn out small and splits skewed
    joins, so erring high is cheap.
    """
    partitions = max(2 * cores, min(200_000, input_bytes // (128 * 1024**2)))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(256 * 1024**2 if input_bytes > 1024**4 else 128 * 1024**2),
        "spark.sql.session.timeZone": "UTC",
    }
