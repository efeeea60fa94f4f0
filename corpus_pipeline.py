"""A corpus pipeline: language, near-duplicates, benchmark passages, token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept; ``run`` writes each result to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from passagelake.llm import cross_parsing, decontamination, sentence_pieces, simhash
from passagelake.llm.queries import tokenizer_path
from passagelake.session import reliable, scratch_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def numbered(docs: DataFrame) -> DataFrame:
    """The columns of documents with ``_row``, the same number whenever the rows are read.

    It is a row's place in its file, after the rows of the files before; rows that do not
    come straight from files are stored first.
    """
    docs = docs.select(COLUMNS)
    place = F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place")
    try:
        placed = docs.select("*", *place)
    except AnalysisException:
        placed = reliable(docs).select("*", *place)
    # One row per file.
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = placed.groupBy("_file").agg((F.max("_place") + 1).alias("_rows"))
    before = files.select("_file", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_file").select(*COLUMNS, (F.col("_before") + F.col("_place")).alias("_row"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that no language is found for: null texts and texts without a letter."""
    model = cross_parsing.train(cross_parsing.training_rows(docs))
    rows = numbered(docs)
    found = cross_parsing.identify(rows, model, id_col="_row")
    rejected = found.where(F.col("lang_pred") == cross_parsing.UNDETERMINED).select(F.col("doc_id").alias("_row"))
    return rows.join(rejected, "_row", "left_anti").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: a row with the group's smallest doc_id."""
    rows = numbered(docs)
    classes = simhash.near_duplicates(rows, id_col="_row").select(F.col("doc_id").alias("_row"), "class_fp")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    first = rows.select("_row", "doc_id").join(classes, "_row").groupBy("class_fp").agg(F.min(order).alias("first"))
    return rows.join(first.select("first._row"), "_row").select(COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item. Null and empty texts hold none; other columns are dropped."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = numbered(docs)
    found = decontamination.contaminations(rows, benchmark, id_col="_row")
    return rows.join(found.select(F.col("doc_id").alias("_row")).distinct(), "_row", "left_anti").select(COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids, and whether decoding them gives the text back; other columns are dropped."""
    return sentence_pieces.encode_documents(docs.select(COLUMNS), tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("encoded", encoded),
]

#: No stage but the choice of rows can be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = scratch_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
