"""Seeded shuffles that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from passagelake.session import reliable

HEX_DIGITS = 12


def shuffle_key(key: Column, seed: int) -> Column:
    """Pseudo-random order of a stable key: the same on every run and layout."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def sample_rows(
    df: DataFrame, key_col: str, max_rows: int, seed: int = 42, total: int | None = None
) -> DataFrame:
    """The first ``max_rows`` rows of the seeded shuffle of ``df``.

    A plain sort-and-limit would send ``max_rows`` rows of every partition to one
    task. Hash values are uniform, so a threshold a little above the wanted
    fraction already leaves about the right number of rows; the sort then sees
    only those. Should fewer remain (many rows sharing a key), all rows compete.
    Rows with a null key have no place in the shuffle and are never taken.
    ``total`` is the number of rows, where it is known; about right is enough.
    """
    if max_rows <= 0:
        return df.limit(0)
    shuffled = df.where(F.col(key_col).isNotNull()).withColumn("_shuffle", shuffle_key(F.col(key_col), seed))

    def first(rows):
        return rows.orderBy("_shuffle", key_col).limit(max_rows).drop("_shuffle")

    total = df.count() if total is None else total
    expected = 2 * max_rows + 1000
    if total > 4 * expected:
        cut = format(int(expected / total * 16**HEX_DIGITS), f"0{HEX_DIGITS}x")
        sample = reliable(first(shuffled.where(F.col("_shuffle") < cut)))
        if sample.count() == max_rows:
            return sample
    return first(shuffled)
