"""Dense numbering inside groups, without ever holding a group in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from passagelake.session import shuffle_partitions

ROWS_PER_BIN = 50_000
MAX_DIGITS = 6
MAX_PARTITIONS = 200_000


def dense_labels(
    rows: DataFrame,
    group_col: str = "centroid_idx",
    key_col: str = "chunk_id",
    total: int | None = None,
    rows_per_bin: int = ROWS_PER_BIN,
) -> DataFrame:
    """Add ``label``: 0..n-1 inside every group, in the order of md5(key), key.

    A hot group may hold a third of all rows, so it is cut into bins by the
    leading hex digits of the hash. Bins keep the hash order; a small count per
    (group, bin) gives each its offset, and only one bin is ever sorted at a time.
    ``total`` is the number of rows, where it is known; about right is enough.
    The rows are shuffled once, by (group, bin): the hash join that adds the offsets
    leaves them where the numbering needs them. The hint also rules out the plan
    that broadcasts the rows and numbers them where their group's counts were.
    """
    total = rows.count() if total is None else total
    digits = 0
    if total > rows_per_bin:
        digits = min(MAX_DIGITS, math.ceil(math.log(total / rows_per_bin, 16)))
    hashed = rows.withColumn("_hash", F.md5(F.col(key_col).cast("string")))
    binned = hashed.withColumn("_bin", F.substring("_hash", 1, digits) if digits else F.lit(""))
    counted = binned
    partitions = total // rows_per_bin
    if partitions > shuffle_partitions(rows.sparkSession):
        # More rows than the session's setting is meant for: size the one shuffle.
        binned = binned.repartition(min(partitions, MAX_PARTITIONS), group_col, "_bin")
    before = Window.partitionBy(group_col).orderBy("_bin").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        counted.groupBy(group_col, "_bin")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(group_col, "_bin", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    )
    inside = Window.partitionBy(group_col, "_bin").orderBy("_hash", key_col)
    return (
        binned.join(offsets.hint("shuffle_hash"), [group_col, "_bin"])
        .withColumn("label", F.col("_base") + F.row_number().over(inside) - 1)
        .select(*rows.columns, "label")
    )
