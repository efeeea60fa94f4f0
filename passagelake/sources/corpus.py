"""Reading raw documents: gzipped JSON lines, numbered file ranges, published tables."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from passagelake.functions.text import is_blank
from passagelake.operators.sampling import sample_rows
from passagelake.schemas import RAW_DOCUMENT
from passagelake.session import reliable
from passagelake.sources.gzip_members import is_damaged

INVALID_JSON = "Invalid JSON"
EMPTY_TEXT = "Empty text"
DAMAGED = "Damaged or incomplete file"
NOT_NUMBERED = "No number in the name"
FILE_NUMBER = r"-(\d{5,})(?=[./])"
INFLATE_BYTES = 1024 * 1024
#: Schemes whose files tasks open without further libraries.
OPENED = {"file", "s3", "s3a", "gs"}

# More files than this and their offsets are joined instead of broadcast.
BROADCAST_FILES = 200_000


def spread_small_input(rows: DataFrame) -> DataFrame:
    """Redistribute freshly read rows if they came in fewer splits than there are cores.

    A single file or row group would otherwise keep one core busy with all the
    text work that follows. Input of any size worth a cluster has more splits than
    cores and passes through without a shuffle. Call it on a scan, before joins.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.isStreaming or rows.rdd.getNumPartitions() >= cores:
        return rows
    return rows.repartition(cores)


def read_lines(
    spark: SparkSession,
    paths: str | list[str],
    first_file: int | None = None,
    end_file: int | None = None,
    file_number: str = FILE_NUMBER,
) -> DataFrame:
    """Text lines with their file: value, source_file, block_start, row_id.

    ``first_file`` and ``end_file`` (not included) keep a numbered range; the
    condition is on the path alone, so files outside it are never opened. A file
    without a number is in no range; ``skipped_files`` lists those. ``row_id`` rises
    with the lines of a split of a file. Damaged files give the lines before the
    damage here; ``read_corpus`` leaves them out.
    """
    lines = (
        spark.read.option("lineSep", "\n")
        .option("ignoreCorruptFiles", True)
        .option("ignoreMissingFiles", True)
        .text(paths)
        .select(
            "value",
            F.col("_metadata.file_path").alias("source_file"),
            F.col("_metadata.file_block_start").alias("block_start"),
        )
    )
    lines = _in_range(lines, first_file, end_file, file_number)
    return lines.withColumn("row_id", F.monotonically_increasing_id())


def _in_range(files: DataFrame, first_file, end_file, file_number: str) -> DataFrame:
    number = F.regexp_extract("source_file", file_number, 1).try_cast("bigint")
    if first_file is not None:
        files = files.where(number >= first_file)
    if end_file is not None:
        files = files.where(number < end_file)
    return files


def _broken_gzip(content: bytes) -> bool:
    """Whether the bytes are not a whole gzip file; inflated in pieces that are thrown away."""
    at = memoryview(content)
    if not len(at):
        return True
    try:
        while len(at):
            unpack = zlib.decompressobj(31)
            data = bytes(at[:INFLATE_BYTES])
            at = at[INFLATE_BYTES:]
            while True:
                while data and not unpack.eof:
                    unpack.decompress(data, INFLATE_BYTES)
                    data = unpack.unconsumed_tail
                if unpack.eof or not len(at):
                    break
                data, at = bytes(at[:INFLATE_BYTES]), at[INFLATE_BYTES:]
            if not unpack.eof:
                return True
            rest = len(unpack.unused_data)
            at = memoryview(content)[len(content) - len(at) - rest :]
    except zlib.error:
        return True
    return False


def skipped_files(
    spark: SparkSession,
    paths: str | list[str],
    first_file: int | None = None,
    end_file: int | None = None,
    file_number: str = FILE_NUMBER,
) -> DataFrame:
    """Files that are not read: source_file, reason.

    Compressed files of the range are read through once, in pieces, to see that they are whole. On
    file systems that only Spark can open they are held one at a time. If a range is asked for, files whose name has no number are listed too.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("ignoreMissingFiles", True)
    listed = files.load(paths).select(F.col("_metadata.file_path").alias("source_file"), "path", "content")
    sample = listed.select("path").first()
    opened = sample is None or sample["path"].partition(":")[0] in OPENED
    listed = listed.drop("content" if opened else "path")

    def damaged(batches):
        for batch in batches:
            if opened:
                broken = [is_damaged(path) for path in batch.column("path").to_pylist()]
            else:
                broken = [_broken_gzip(value.as_buffer()) for value in batch.column("content")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("source_file").filter(pa.array(broken, pa.bool_()))], ["source_file"]
            )

    found = _in_range(listed, first_file, end_file, file_number).mapInArrow(damaged, "source_file string")
    skipped = found.withColumn("reason", F.lit(DAMAGED))
    if first_file is None and end_file is None:
        return skipped
    names = (
        spark.read.format("binaryFile").option("ignoreMissingFiles", True)
        .load(paths).select(F.col("_metadata.file_path").alias("source_file"))
    )
    nameless = names.where(~F.col("source_file").rlike(file_number)).withColumn("reason", F.lit(NOT_NUMBERED))
    return skipped.unionByName(nameless)


def number_lines(lines: DataFrame) -> DataFrame:
    """Add ``line_num``: the line's 0-based place in its file, whether the file is split or not.

    Blank lines before the first text do not count (their number is negative). A
    small count per file and split gives each split its offset; the lines stay where
    they are. The input is read a second time for the counts.
    """
    text = F.when(~is_blank(F.col("value")), F.col("row_id"))
    splits = lines.groupBy("source_file", "block_start").agg(
        F.min("row_id").alias("_first"), F.count(F.lit(1)).alias("_lines"), F.min(text).alias("_text")
    )
    by_file = Window.partitionBy("source_file")
    earlier = by_file.orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_lines").over(earlier), F.lit(0))
    placed = splits.withColumn("_before", before).withColumn(
        "_start", F.min(F.col("_text") - F.col("_first") + F.col("_before")).over(by_file)
    )
    offsets = placed.select(
        "source_file",
        "block_start",
        (F.col("_before") - F.col("_first") - F.coalesce("_start", F.lit(0))).alias("_offset"),
    )
    # One small row per file and split: sent along where their number allows it, so that no
    # line is shuffled.
    if len(lines.inputFiles()) + lines.rdd.getNumPartitions() <= BROADCAST_FILES:
        offsets = F.broadcast(offsets)
    return (
        lines.join(offsets, ["source_file", "block_start"])
        .withColumn("line_num", F.col("row_id") + F.col("_offset"))
        .select(*lines.columns, "line_num")
    )


def parse_documents(lines: DataFrame, line_num: Column | None = None) -> DataFrame:
    """Documents of JSON lines: id, text, source_file, reason.

    ``reason`` is null for usable lines. Text defaults to empty; a missing or null
    id becomes ``{source_file}_{line_num}``.
    """
    schema = f"{RAW_DOCUMENT}, _corrupt_record string"
    parsed = lines.where(~is_blank(F.col("value"))).withColumn(
        "_doc", F.from_json("value", schema, {"mode": "PERMISSIVE"})
    )
    doc = F.col("_doc")
    broken = doc.isNull() | doc["_corrupt_record"].isNotNull()
    line_id = doc["id"]
    if line_num is not None:
        line_id = F.coalesce(line_id, F.concat_ws("_", "source_file", line_num))
    return parsed.select(
        line_id.alias("id"),
        F.coalesce(doc["text"], F.lit("")).alias("text"),
        "source_file",
        "value",
        F.when(broken, INVALID_JSON).alias("reason"),
    )


@dataclass
class CorpusRead:
    """A corpus as read: usable documents, lines that were rejected, files that were left out."""

    lines: DataFrame
    skipped: DataFrame

    @property
    def documents(self) -> DataFrame:
        return self.lines.where("reason is null").select("id", "text", "source_file")

    @property
    def rejected(self) -> DataFrame:
        """value, source_file and reason of lines without a usable document."""
        return self.lines.where("reason is not null").select("value", "source_file", "reason")

    def report(self) -> DataFrame:
        """Per file: kept and rejected lines, or why the file was skipped."""
        counted = self.lines.groupBy("source_file").agg(
            F.count_if(F.col("reason").isNull()).alias("kept"),
            F.count_if(F.col("reason") == INVALID_JSON).alias("invalid"),
            F.count_if(F.col("reason") == EMPTY_TEXT).alias("empty"),
        )
        return counted.join(self.skipped.withColumnRenamed("reason", "skipped"), "source_file", "full").select(
            "source_file", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("kept", "invalid", "empty")], "skipped"
        )


def read_corpus(
    spark: SparkSession,
    paths: str | list[str],
    first_file: int | None = None,
    end_file: int | None = None,
    number_missing_ids: bool = True,
) -> CorpusRead:
    """Read a corpus of JSON lines whole files at a time; see CorpusRead.

    A damaged file gives no documents at all. A missing or null id becomes file and
    line number; ``number_missing_ids`` False leaves it null and saves counting lines.
    """
    skipped = reliable(skipped_files(spark, paths, first_file, end_file))
    lines = read_lines(spark, paths, first_file, end_file).join(
        skipped.where(F.col("reason") == DAMAGED).select("source_file"), "source_file", "left_anti"
    )
    line_num = None
    if number_missing_ids:
        lines, line_num = number_lines(lines), F.col("line_num")
    parsed = parse_documents(lines, line_num)
    reason = F.coalesce("reason", F.when(F.col("text") == "", EMPTY_TEXT))
    return CorpusRead(parsed.withColumn("reason", reason), skipped)


def read_documents(
    spark: SparkSession,
    paths: str | list[str],
    first_file: int | None = None,
    end_file: int | None = None,
    number_missing_ids: bool = True,
) -> DataFrame:
    """Documents with text: id, text, source_file. ``read_corpus`` also gives what was left out."""
    return read_corpus(spark, paths, first_file, end_file, number_missing_ids).documents


def read_in_order(spark: SparkSession, *paths: str) -> DataFrame:
    """A published parquet dataset with ``position``, the row's 0-based input order.

    Order is file path, then row within the file. Both come from the file itself,
    so the position does not depend on how the input is split.
    """
    rows = spark.read.parquet(*paths)
    columns = rows.columns
    placed = rows.select(
        *columns,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias("_row"),
    )
    # One row per file, so one task can order them.
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_file")
        .agg((F.max("_row") + 1).alias("_rows"))
        .select("_file", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_base"))
    )
    if len(rows.inputFiles()) <= BROADCAST_FILES:
        offsets = F.broadcast(offsets)
    return placed.join(offsets, "_file").select(
        *columns, (F.col("_base") + F.col("_row")).alias("position")
    )


def files_to_fetch(target_mb: float, avg_file_mb: float) -> int:
    return max(1, int(target_mb / avg_file_mb))


def sample_missing_files(
    index: DataFrame,
    stored: DataFrame,
    path_col: str = "path",
    target_mb: float = 5120,
    avg_file_mb: float = 100,
    seed: int = 42,
) -> DataFrame:
    """A seeded sample of the indexed files, each with ``already_stored``.

    Only files that are not stored are to be fetched; running it again is harmless.
    """
    sample = sample_rows(index, path_col, files_to_fetch(target_mb, avg_file_mb), seed)
    have = stored.select(path_col).distinct()
    missing = sample.join(have, path_col, "left_anti").withColumn("already_stored", F.lit(False))
    present = sample.join(have, path_col, "left_semi").withColumn("already_stored", F.lit(True))
    return missing.unionByName(present)


def fetch_summary(sample: DataFrame) -> DataFrame:
    stored = F.col("already_stored")
    return sample.agg(
        F.count_if(~stored).alias("downloaded"),
        F.count_if(stored).alias("skipped_existing"),
        F.count(F.lit(1)).alias("attempted"),
    )


def keep_language(
    files: DataFrame,
    order_col: str,
    lang_col: str = "lang",
    lang: str = "en",
    min_files: int | None = None,
) -> DataFrame:
    """Walk the files in order, keeping one language, until ``min_files`` are kept.

    Returns the files walked with ``kept``; the last row walked is the last one
    kept. Without a minimum, every file is walked.
    """
    marked = files.withColumn("kept", F.coalesce(F.col(lang_col) == lang, F.lit(False)))
    if min_files is None:
        return marked
    # Kept files are numbered without a sort in one task: equal ranges of the order are
    # counted, and only a file's own range is ordered inside. The ranges are drawn from a
    # sample and so stored: what counts them and what orders them must see the same ones.
    ranges = reliable(
        marked.where("kept").repartitionByRange(order_col).select(
            order_col, F.spark_partition_id().alias("_range")
        )
    )
    counts = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.max(order_col).alias("_last"))
    before = F.coalesce(
        F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    # The one range in which the wanted file lies, with its number there.
    holding = counts.withColumn("_before", before).where(
        (F.col("_before") < min_files) & (F.col("_before") + F.col("_n") >= min_files)
    )
    inside = Window.partitionBy("_range").orderBy(order_col)
    end = (
        ranges.join(holding, "_range")
        .withColumn("_place", F.row_number().over(inside) + F.col("_before"))
        .where(F.col("_place") == min_files)
        .agg(F.max(order_col).alias("_end"))
    )
    # One row: the last file walked, null if there are not enough files.
    return (
        marked.join(F.broadcast(end))
        .where(F.col("_end").isNull() | (F.col(order_col) <= F.col("_end")))
        .drop("_end")
    )


def language_summary(walked: DataFrame) -> DataFrame:
    return walked.agg(
        F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("skipped_language")
    )
