"""Which keys are stored already: Bloom filters kept beside the store, with an exact check behind them.

A filter is a table of 64-bit words. A key sets four bits of one word, so a key is one row
when a filter is built, rows of a word are combined by ``bit_or`` before and after the
shuffle, and filters of several batches are merged the same way. A key whose bits are not all
set is not stored, and most keys that are not need nothing more. The others are compared with the
store itself, of which only rows with a candidate's bits are shuffled, or none if the candidates are few.

Layout below the folder::

    words/batch=N/       word, bits
    manifest/batch=N/    words, keys: the filter's length and the batch's rows; written last
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from passagelake.session import reliable

#: Bits that a filter has for each key it is made for: about one key in 100 is a false candidate.
BITS_PER_KEY = 16
WORD_BITS = 64
#: Words and candidates that are sent to every task; more of them are joined by a shuffle.
BROADCAST_WORDS = 2_000_000
BROADCAST_KEYS = 200_000

WORDS = "word bigint, bits bigint"
MANIFEST = "words bigint, keys bigint"


def words_for(keys: int, bits_per_key: int = BITS_PER_KEY) -> int:
    """How many words a filter for so many keys has."""
    return max(1, -(-keys * bits_per_key // WORD_BITS))


def _place(key: Column, words: int) -> dict[str, Column]:
    """A key's word and the bits it sets there."""
    spread = F.xxhash64(key.cast("string"), F.lit(1))

    def bit(shift: int) -> Column:
        at = F.shiftrightunsigned(spread, shift).bitwiseAND(F.lit(WORD_BITS - 1)).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), at)

    mask = bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12)).bitwiseOR(bit(18))
    return {"_word": F.pmod(F.xxhash64(key.cast("string"), F.lit(2)), F.lit(words)), "_mask": mask}


def filter_words(keys: DataFrame, key_col: str, words: int) -> DataFrame:
    """The words (word, bits) of a filter over the keys that are not null."""
    placed = keys.where(F.col(key_col).isNotNull()).select(*[c.alias(n) for n, c in _place(F.col(key_col), words).items()])
    return placed.groupBy(F.col("_word").alias("word")).agg(F.bit_or("_mask").alias("bits"))


def add_to_filter(
    keys: DataFrame, folder: str, batch: int = 0, key_col: str = "path", expected_keys: int | None = None
) -> None:
    """Add a batch of stored keys to the filter of a folder; adding a batch again replaces it.

    The first batch sets the filter's length, for ``expected_keys`` or four times its own rows. A filter that has
    taken more keys than it was made for stays right and lets more candidates through.
    """
    spark = keys.sparkSession
    count = keys.where(F.col(key_col).isNotNull()).count()
    words = filter_length(spark, folder)
    if words is None:
        words = words_for(max(expected_keys or 4 * count, 1))
    filter_words(keys, key_col, words).write.mode("overwrite").parquet(f"{folder}/words/batch={batch}")
    spark.range(1).select(F.lit(words).cast("bigint").alias("words"), F.lit(count).cast("bigint").alias("keys")).coalesce(
        1
    ).write.mode("overwrite").parquet(f"{folder}/manifest/batch={batch}")


def _manifest(spark: SparkSession, folder: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(f"{MANIFEST}, batch int").parquet(f"{folder}/manifest")


def filter_length(spark: SparkSession, folder: str) -> int | None:
    """How many words the filter of a folder has; None if there is no filter."""
    manifest = _manifest(spark, folder)
    return None if manifest is None else manifest.agg(F.max("words")).first()[0]


def read_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The merged words of all batches that the manifest has."""
    listed = _manifest(spark, folder)
    if listed is None:
        raise ValueError(f"no filter in {folder}")
    # One row per batch.
    batches = [r.batch for r in listed.select("batch").distinct().collect()]
    words = spark.read.schema(f"{WORDS}, batch int").parquet(f"{folder}/words").where(F.col("batch").isin(batches))
    return words.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def _candidates(rows: DataFrame, key_col: str, filtered: DataFrame, words: int) -> DataFrame:
    """Add ``_maybe``: whether all bits of the row's key are set."""
    if words <= BROADCAST_WORDS:
        filtered = F.broadcast(filtered)
    placed = rows.withColumns(_place(F.col(key_col), words))
    looked = placed.join(filtered.withColumnRenamed("word", "_word").withColumnRenamed("bits", "_bits"), "_word", "left")
    hit = F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask")
    maybe = F.coalesce(hit, F.lit(False)) & F.col(key_col).isNotNull()
    return looked.select(*rows.columns, maybe.alias("_maybe"))


def _near_candidates(have: DataFrame, asked: DataFrame, count: int, broadcast_keys: int) -> DataFrame:
    """The store's keys that are candidates, or, with many of these, that have a candidate's bits.

    No key is shuffled to find that out, unless the candidates' filter is too long to be sent along.
    """
    if count <= broadcast_keys:
        return have.join(F.broadcast(asked), "_key", "left_semi")
    own = words_for(count)
    return _candidates(have, "_key", reliable(filter_words(asked, "_key", own)), own).where("_maybe").select("_key")


def mark_stored(
    rows: DataFrame, stored: DataFrame, folder: str, key_col: str = "path", broadcast_keys: int = BROADCAST_KEYS
) -> DataFrame:
    """Add ``already_stored`` to the rows, exactly, with the filter of the store's folder.

    Every key of ``stored`` must be in the filter: ``add_to_filter`` it when it is stored. A key that is in the filter
    and gone from the store counts as missing. Null keys are not stored; repeated rows stay.
    """
    spark = rows.sparkSession
    words = filter_length(spark, folder)
    if words is None:
        raise ValueError(f"no filter in {folder}")
    split = reliable(_candidates(rows, key_col, read_filter(spark, folder), words))
    asked = reliable(split.where("_maybe").select(F.col(key_col).alias("_key")).distinct())
    count = asked.count()
    near = _near_candidates(stored.select(F.col(key_col).alias("_key")), asked, count, broadcast_keys).distinct()
    present = near if count <= broadcast_keys else near.join(asked, "_key", "left_semi")
    found = present.withColumn("already_stored", F.lit(True))
    if count <= broadcast_keys:
        found = F.broadcast(found)
    marked = split.withColumnRenamed(key_col, "_key").join(found, "_key", "left")
    return marked.select(
        *[F.col("_key").alias(c) if c == key_col else F.col(c) for c in rows.columns],
        F.coalesce("already_stored", F.lit(False)).alias("already_stored"),
    )
