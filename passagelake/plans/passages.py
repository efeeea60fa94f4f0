"""Queries over documents and their passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from passagelake.functions.ids import normalize_doc_id, preview
from passagelake.functions.text import BLANK_LINES, LINE_ENDS, paragraphs, word_count
from passagelake.operators.chunking import chunk_documents as cut
from passagelake.operators.row_packing import pack_rows
from passagelake.operators.membership import add_to_filter, mark_stored
from passagelake.operators.reports import chunk_counts
from passagelake.plans.catalog import query, table, text_table
from passagelake.session import reliable, scratch_folder
from passagelake.sources.corpus import (
    fetch_summary,
    keep_language,
    language_summary,
    parse_documents,
    read_corpus,
    read_documents,
    read_in_order,
    sample_missing_files as sample_files,
)
from passagelake.sources.gzip_members import index_members, listed_files, member_runs, read_runs, write_members
from passagelake.sources.export import export_documents, export_summary as summarize, plan_shards

BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def chunk_sql(documents: str, breaks: str) -> str:
    """CTEs ending in ``chunks``: the packing rule as a recursion over paragraphs.

    ``documents`` selects doc_id (text), source_file and text.
    """
    return f"""
    RECURSIVE input AS ({documents}),
    split AS (
      SELECT doc_id, source_file, list_filter(
        list_transform(regexp_split_to_array(text, '{breaks}'), lambda x: trim(x, {BLANK})),
        lambda x: x <> '') AS parts FROM input WHERE text <> ''),
    paras AS (
      SELECT doc_id, source_file, generate_subscripts(parts, 1) AS i, unnest(parts) AS p FROM split),
    counted AS (
      SELECT *, len(regexp_split_to_array(p, '\\s+')) AS n FROM paras),
    packed AS (
      SELECT doc_id, i, n AS words, 0 AS ord FROM counted WHERE i = 1
      UNION ALL
      SELECT c.doc_id, c.i,
             CASE WHEN r.words + c.n > 300 THEN c.n ELSE r.words + c.n END,
             CASE WHEN r.words + c.n > 300 THEN r.ord + 1 ELSE r.ord END
      FROM packed r JOIN counted c ON c.doc_id = r.doc_id AND c.i = r.i + 1),
    chunks AS (
      SELECT string_agg(p, chr(10) || chr(10) ORDER BY c.i) AS chunk, c.doc_id,
             c.doc_id || '_chunk_' || ord AS chunk_id, any_value(source_file) AS source_file
      FROM counted c JOIN packed k ON c.doc_id = k.doc_id AND c.i = k.i
      GROUP BY c.doc_id, ord)"""


DOCUMENTS_SQL = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, source AS source_file, text FROM documents"
CHUNK_ROWS = """SELECT chunk, doc_id, CAST(length(chunk) AS BIGINT) AS chunk_len, chunk_id, source_file
    FROM chunks"""
LINES = "\\n"
BLANKS = "\\n\\s*\\n"


def document_chunks(spark: SparkSession, sf_dir: str, separator: str = LINE_ENDS) -> DataFrame:
    """Passages of the documents table; its texts have lines, not blank lines."""
    return cut(text_table(spark, sf_dir, "documents"), "doc_id", source_col="source", separator=separator)


def _chunk_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "chunk", "doc_id", F.col("chunk_len").cast("bigint").alias("chunk_len"), "chunk_id",
        "source_file",
    )


@query(f"WITH {chunk_sql(DOCUMENTS_SQL, BLANKS)} {CHUNK_ROWS}")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(document_chunks(spark, sf_dir, BLANK_LINES))


@query(f"WITH {chunk_sql(DOCUMENTS_SQL, LINES)} {CHUNK_ROWS}")
def chunk_documents_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(document_chunks(spark, sf_dir))


@query(f"WITH {chunk_sql(DOCUMENTS_SQL, LINES)} SELECT chunk, doc_id, chunk_id FROM chunks")
def packed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same passages from lines that are rows, in blocks: no task holds a document."""
    lines = text_table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", LINE_ENDS)).alias("line", "text")
    )
    return pack_rows(lines, order_col="line", block_rows=512).select("chunk", "doc_id", "chunk_id")


# The turns of a role as one document: longer than any block.
@query(f"""WITH RECURSIVE turns AS (SELECT role AS doc_id, conv_id, turn, trim(text, {BLANK}) AS p FROM conversations
      WHERE role IS NOT NULL AND trim(text, {BLANK}) <> ''),
    counted AS (SELECT doc_id, p, len(regexp_split_to_array(p, '\\s+')) AS n,
      row_number() OVER (PARTITION BY doc_id ORDER BY conv_id, turn, p) AS i FROM turns),
    packed AS (
      SELECT doc_id, i, n AS words, 0 AS ord FROM counted WHERE i = 1
      UNION ALL
      SELECT c.doc_id, c.i, CASE WHEN r.words + c.n > 300 THEN c.n ELSE r.words + c.n END,
             CASE WHEN r.words + c.n > 300 THEN r.ord + 1 ELSE r.ord END
      FROM packed r JOIN counted c ON c.doc_id = r.doc_id AND c.i = r.i + 1)
    SELECT k.doc_id, CAST(ord AS BIGINT) AS ordinal, string_agg(p, chr(10) || chr(10) ORDER BY c.i) AS chunk
    FROM counted c JOIN packed k ON c.doc_id = k.doc_id AND c.i = k.i GROUP BY ALL""")
def packed_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of a role as one document, which no task holds."""
    turns = table(spark, sf_dir, "conversations").select("role", F.struct("conv_id", "turn").alias("at"), "text")
    return pack_rows(turns, "role", "at", block_rows=512).select("doc_id", "ordinal", "chunk")


TURNS_SQL = """SELECT conv_id || '_' || turn AS doc_id, role AS source_file, text FROM conversations"""


@query(f"WITH {chunk_sql(TURNS_SQL, LINES)} {CHUNK_ROWS}")
def conversation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = text_table(spark, sf_dir, "conversations").select(
        F.concat_ws("_", "conv_id", "turn").alias("id"), "text", F.col("role").alias("source_file")
    )
    return _chunk_rows(cut(turns, separator=LINE_ENDS))


@query(f"""WITH {chunk_sql(DOCUMENTS_SQL, LINES)}
    SELECT doc_id, CAST(i - 1 AS BIGINT) AS paragraph, CAST(n AS BIGINT) AS words FROM counted""")
def paragraph_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = text_table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.posexplode(paragraphs(F.col("text"), LINE_ENDS)).alias("paragraph", "p"),
    )
    return parts.select(
        "doc_id",
        F.col("paragraph").cast("bigint").alias("paragraph"),
        word_count(F.col("p")).cast("bigint").alias("words"),
    )


@query(f"""WITH {chunk_sql(DOCUMENTS_SQL, LINES)}
    SELECT source_file, CAST(count(*) AS BIGINT) AS chunks FROM chunks GROUP BY ROLLUP (source_file)""")
def chunk_stats_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_counts(document_chunks(spark, sf_dir))


# Lines of a raw corpus made from the documents: German ones are cut off, Spanish
# ones have no id, French ones no text, and very short ones are blank lines.
RAW_REASON = """CASE WHEN lang = 'de' THEN 'Invalid JSON' END"""


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.col("lang")
    record = F.to_json(
        F.struct(
            F.when(lang != "es", F.col("doc_id")).alias("id"),
            F.when(lang != "fr", F.col("text")).alias("text"),
            "lang",
        )
    )
    value = (
        F.when(F.col("n_chars") < 40, "  ")
        .when(lang == "de", F.concat(F.lit("{"), record))
        .otherwise(record)
    )
    return text_table(spark, sf_dir, "documents").select(
        value.alias("value"),
        F.col("source").alias("source_file"),
        F.col("doc_id").alias("line_num"),
    )


@query(f"""SELECT CASE WHEN lang = 'de' THEN source || '_' || doc_id
                       WHEN lang = 'es' THEN source || '_' || doc_id
                       ELSE CAST(doc_id AS VARCHAR) END AS id,
      CAST(CASE WHEN lang IN ('fr', 'de') THEN 0 ELSE length(text) END AS BIGINT) AS chars,
      source AS source_file, {RAW_REASON} AS reason
    FROM documents WHERE n_chars >= 40""")
def parse_raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = raw_lines(spark, sf_dir)
    parsed = parse_documents(lines, F.col("line_num"))
    return parsed.select(
        "id", F.length("text").cast("bigint").alias("chars"), "source_file", "reason"
    )


@query(f"""WITH {chunk_sql(DOCUMENTS_SQL, BLANKS)}
    SELECT doc_id, chunk_id, CAST(length(chunk) AS BIGINT) AS chunk_len FROM chunks""")
def exported_corpus_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export the documents as gzipped JSON lines, read the files back, and chunk them."""
    folder = scratch_folder(spark, "corpus")
    rows = read_in_order(spark, f"{sf_dir}/documents.parquet")
    export_documents(rows.withColumnRenamed("doc_id", "id"), folder)
    chunks = cut(read_documents(spark, folder, first_file=0))
    return chunks.select("doc_id", "chunk_id", F.col("chunk_len").cast("bigint").alias("chunk_len"))


def break_off(spark: SparkSession, folder: str, path: str) -> None:
    """Write the first half of one of a folder's compressed files, as an upload that stopped leaves it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.gz").load(folder)
    whole = files.orderBy("length", "path").select("content").first()["content"]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    with_bytes = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    with_bytes.write(bytearray(whole[: len(whole) // 2]))
    with_bytes.close()


# The same lines as gzipped files, one or more for each source, and one that is broken off.
@query(f"""SELECT 'broken' AS source, CAST(0 AS BIGINT) AS kept, CAST(0 AS BIGINT) AS invalid,
      CAST(0 AS BIGINT) AS empty, CAST(1 AS BIGINT) AS skipped_files
    UNION ALL SELECT source, CAST(count(*) FILTER (lang NOT IN ('fr', 'de')) AS BIGINT) AS kept,
      CAST(count(*) FILTER (lang = 'de') AS BIGINT) AS invalid,
      CAST(count(*) FILTER (lang = 'fr') AS BIGINT) AS empty, CAST(0 AS BIGINT) AS skipped_files
    FROM documents WHERE n_chars >= 40 GROUP BY source""")
def corpus_read_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reading a raw corpus kept, rejected and skipped, by source."""
    folder = scratch_folder(spark, "raw")
    written = raw_lines(spark, sf_dir).select("value", F.col("source_file").alias("src"))
    written.write.partitionBy("src").option("compression", "gzip").text(folder)
    break_off(spark, folder, f"{folder}/src=broken/part-0.txt.gz")
    report = read_corpus(spark, folder).report()
    return report.groupBy(F.regexp_extract("source_file", "src=([^/]*)", 1).alias("source")).agg(
        F.sum("kept").alias("kept"),
        F.sum("invalid").alias("invalid"),
        F.sum("empty").alias("empty"),
        F.count("skipped").alias("skipped_files"),
    )


@query(f"""SELECT CAST(ceil(count(*) / 250.0) AS BIGINT) AS chunks_uploaded,
      CAST(count(*) AS BIGINT) AS documents_uploaded, true AS bytes_are_the_files FROM documents""")
def export_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an export wrote; its bytes are held against the sizes that reading its files tells."""
    folder = scratch_folder(spark, "export")
    rows = read_in_order(spark, f"{sf_dir}/documents.parquet").withColumnRenamed("doc_id", "id")
    export_documents(rows, folder, chunk_size=250)
    summary = summarize(plan_shards(rows, 250), "documents", "train", folder)
    lines = spark.read.text(folder).select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("n"))
    told = lines.distinct().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return summary.select(
        "chunks_uploaded", "documents_uploaded", (F.col("bytes_uploaded") == told).alias("bytes_are_the_files")
    )


@query("""SELECT doc_id, md5(doc_id || ' ' || translate(text, chr(10) || chr(13), '  ')) AS line_hash FROM documents""")
def member_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as lines of gzip files with many members, which are read in runs by many tasks."""
    line = F.concat_ws(" ", F.col("doc_id").cast("string"), F.translate("text", "\n\r", "  "))
    lines = table(spark, sf_dir, "documents").select(line.alias("value"))
    folder = write_members(lines, scratch_folder(spark, "members"), member_bytes=64 * 1024)
    members = reliable(index_members(listed_files(spark, folder)))
    found = read_runs(member_runs(members, run_bytes=128 * 1024))
    return found.select(
        F.substring_index("value", " ", 1).cast("bigint").alias("doc_id"), F.md5("value").alias("line_hash")
    )


PLAN_SHARD = 300


@query(f"""WITH placed AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents)
    SELECT doc_id, CAST(position AS BIGINT) AS position,
           CAST(position // {PLAN_SHARD} AS BIGINT) AS shard FROM placed""")
def export_shard_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_in_order(spark, f"{sf_dir}/documents.parquet")
    return plan_shards(rows, PLAN_SHARD).select("doc_id", "position", "shard")


@query(f"""SELECT 'documents' AS dataset_id, 'train' AS split,
      CAST(ceil(count(*) / {PLAN_SHARD}.0) AS BIGINT) AS chunks_uploaded,
      CAST(count(*) AS BIGINT) AS documents_uploaded FROM documents""")
def export_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_in_order(spark, f"{sf_dir}/documents.parquet")
    return summarize(plan_shards(rows, PLAN_SHARD), "documents", "train")


@query("""WITH ids AS (
      SELECT event_id, CASE event_type WHEN 'click' THEN '00' || user_id WHEN 'view' THEN ' ' || user_id || ' '
             WHEN 'error' THEN 'u' || user_id WHEN 'signup' THEN '-0' || user_id
             ELSE user_id || '.0' END AS given FROM events)
    SELECT event_id, given, coalesce(CAST(TRY_CAST(CASE WHEN regexp_full_match(trim(given), '[+-]?[0-9]+')
             THEN trim(given) END AS HUGEINT) AS VARCHAR), given) AS doc_id FROM ids""")
def normalized_doc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    given = (
        F.when(kind == "click", F.concat(F.lit("00"), user))
        .when(kind == "view", F.concat(F.lit(" "), user, F.lit(" ")))
        .when(kind == "error", F.concat(F.lit("u"), user))
        .when(kind == "signup", F.concat(F.lit("-0"), user))
        .otherwise(F.concat(user, F.lit(".0")))
    )
    ids = table(spark, sf_dir, "events").select("event_id", given.alias("given"))
    return ids.select("event_id", "given", normalize_doc_id(F.col("given")).alias("doc_id"))


@query("""SELECT doc_id, CASE WHEN length(text) > 150 THEN substring(text, 1, 150) || '...' ELSE text END
      AS preview FROM documents""")
def document_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", preview(F.col("text")).alias("preview"))


# Pages whose language tag is English count as already stored.
FETCH_SQL = """WITH sample AS (
      SELECT url, html LIKE '%lang="en"%' AS already_stored FROM pages
      ORDER BY md5('42:' || url), url LIMIT 51)"""


def _fetch_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    stored = pages.where(F.col("html").contains('lang="en"')).select("url")
    return sample_files(pages.select("url"), stored, "url", target_mb=5120, avg_file_mb=100)


@query(f"{FETCH_SQL} SELECT url, already_stored FROM sample")
def sample_missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fetch_sample(spark, sf_dir)


@query(f"""{FETCH_SQL} SELECT CAST(count(*) FILTER (NOT already_stored) AS BIGINT) AS downloaded,
      CAST(count(*) FILTER (already_stored) AS BIGINT) AS skipped_existing,
      CAST(count(*) AS BIGINT) AS attempted FROM sample""")
def fetch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetch_summary(_fetch_sample(spark, sf_dir))


@query("""SELECT url, html LIKE '%lang="en"%' AS already_stored FROM pages""")
def marked_by_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against the stored ones, by a filter that two batches were added to."""
    pages = table(spark, sf_dir, "pages")
    stored = pages.where(F.col("html").contains('lang="en"')).select("url")
    folder = scratch_folder(spark, "filter")
    half = F.xxhash64("url") % 2 == 0
    add_to_filter(stored.where(half), folder, 0, "url", expected_keys=stored.count())
    add_to_filter(stored.where(~half), folder, 1, "url")
    return mark_stored(pages.select("url"), stored, folder, "url")


@query("""SELECT doc_id, lang FROM documents WHERE lang = 'en'""")
def english_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    walked = keep_language(table(spark, sf_dir, "documents"), "doc_id")
    return walked.where("kept").select("doc_id", "lang")


MIN_ENGLISH = 100


@query(f"""WITH english AS (SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT {MIN_ENGLISH}),
      walked AS (SELECT lang FROM documents WHERE doc_id <= (SELECT max(doc_id) FROM english)
                 OR (SELECT count(*) FROM english) < {MIN_ENGLISH})
    SELECT CAST(count(*) FILTER (lang = 'en') AS BIGINT) AS kept,
      CAST(count(*) FILTER (lang <> 'en') AS BIGINT) AS skipped_language FROM walked""")
def english_until_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return language_summary(keep_language(documents, "doc_id", min_files=MIN_ENGLISH))
