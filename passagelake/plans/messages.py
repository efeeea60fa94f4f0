"""Queries over message topics derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from passagelake.operators.validation import (
    dead_letters,
    embed_run_counters as count_run,
    prepare_for_embedding,
    validate_embedded,
)
from passagelake.operators.reports import RunRecord
from passagelake.plans.catalog import query, text_table
from passagelake.session import scratch_folder
from passagelake.sources.deliveries import deliver
from passagelake.sources.index_store import build_index_from_topic, open_index
from passagelake.sources.topic_log import acknowledge, backlog, read_log, send, stream_log
from passagelake.sources.topics import publish, receive, topic_statistics as statistics
from passagelake.streaming.stages import embed_topic

LONG_ID = "123456789012345"


# Embedded chunks made from the embeddings table. The label decides what is wrong:
# 0 cut-off JSON, 1 no chunk_len, 2 a null inside the vector, 3 a number as chunk,
# 4 no doc_id, 5 empty body, 6 a list, 7 chunk_len as text, 8 chunk_id as number,
# 9 nothing, unless the id ends in 1 (chunk_len beyond 32 bits), 2 (a number beyond
# the range of floats), 3 (a fractional chunk_id) or 4 (a chunk_id of 23 digits).
def embedded_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, vec_id = F.col("label"), F.col("vec_id")
    special = F.when(label == 9, vec_id % 10)
    name = F.concat(F.lit("vector "), vec_id)
    numbers = F.transform("embedding", lambda x: x.cast("string"))
    texts = (
        F.when(label == 2, F.array_append(numbers, F.lit("null")))
        .when(special == 2, F.array_append(numbers, F.lit("1e300")))
        .otherwise(numbers)
    )
    quote = F.lit('"')
    body = F.concat_ws(
        ",",
        F.concat(F.lit('"chunk":'), F.when(label == 3, "5").otherwise(F.concat(quote, name, quote))),
        F.concat(
            F.lit('"chunk_id":'),
            F.when(label == 8, vec_id.cast("string"))
            .when(special == 3, F.concat(vec_id.cast("string"), F.lit(".5")))
            .when(special == 4, F.concat(F.lit(LONG_ID), F.lpad(vec_id.cast("string"), 8, "0")))
            .otherwise(F.concat(F.lit('"v'), vec_id, quote)),
        ),
        F.when(label != 4, F.concat(F.lit('"doc_id":'), vec_id)),
        F.when(
            label != 1,
            F.concat(
                F.lit('"chunk_len":'),
                F.when(label == 7, F.concat(quote, F.length(name), quote))
                .when(special == 1, "3000000000")
                .otherwise(F.length(name).cast("string")),
            ),
        ),
        F.concat(F.lit('"embedding":['), F.array_join(texts, ","), F.lit("]")),
    )
    value = (
        F.when(label == 0, F.concat(F.lit("{"), body))
        .when(label == 5, "")
        .when(label == 6, F.concat(F.lit("["), vec_id, F.lit("]")))
        .otherwise(F.concat(F.lit("{"), body, F.lit("}")))
    )
    return text_table(spark, sf_dir, "embeddings").select(value.alias("value"), "label")


VALIDATED_SQL = """WITH checked AS (SELECT vec_id, label, embedding,
      CASE WHEN label = 0 THEN 'Invalid JSON' WHEN label BETWEEN 1 AND 6 THEN 'Schema validation failed'
        WHEN label = 9 AND vec_id % 10 BETWEEN 1 AND 3 THEN 'Schema validation failed'
      END AS reason FROM embeddings)"""


# All numbers of a vector are in its checksum: the sum of each, weighted by its place.
@query(f"""{VALIDATED_SQL} SELECT 'vector ' || vec_id AS chunk,
      CASE WHEN label = 8 THEN CAST(vec_id AS VARCHAR) WHEN label = 9 AND vec_id % 10 = 4
        THEN '{LONG_ID}' || lpad(CAST(vec_id AS VARCHAR), 8, '0') ELSE 'v' || vec_id END AS chunk_id,
      CAST(vec_id AS VARCHAR) AS doc_id,
      CAST(length('vector ' || vec_id) AS BIGINT) AS chunk_len, CAST(len(embedding) AS BIGINT) AS dim,
      round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x * i)), 5) + 0.0 AS checksum
    FROM checked WHERE reason IS NULL""")
def message_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = validate_embedded(embedded_messages(spark, sf_dir))
    return checked.where(F.col("reason").isNull()).select(
        "chunk",
        "chunk_id",
        "doc_id",
        F.col("chunk_len").cast("bigint").alias("chunk_len"),
        F.size("embedding").cast("bigint").alias("dim"),
        F.round(
            F.aggregate(
                F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x
            ),
            5,
        ).alias("checksum"),
    )


@query(f"""{VALIDATED_SQL} SELECT reason, CAST(count(*) AS BIGINT) AS messages FROM checked
      WHERE reason IS NOT NULL GROUP BY reason""")
def dead_letter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = dead_letters(validate_embedded(embedded_messages(spark, sf_dir)))
    return rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("messages"))


# Chunk messages made from the documents. The source decides what is special:
# src0 cut-off JSON, src1 "text" for "chunk", src2 "id" for "chunk_id", src3 no ids,
# src4 empty text, src5 chunk_len 0, src6 padded doc_id, src7 empty body,
# src8 an unreadable chunk_len, src9 no doc_id; the others are complete.
def chunk_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, doc_id = F.col("source"), F.col("doc_id")
    chunk_id = F.concat(F.lit("c"), doc_id)

    def unless(names, value):
        return F.when(~source.isin(*names), value)

    body = F.to_json(
        F.struct(
            F.when(source == "src4", "").otherwise(unless(["src1"], F.col("text"))).alias("chunk"),
            F.when(source == "src1", F.col("text")).alias("text"),
            unless(["src2", "src3"], chunk_id).alias("chunk_id"),
            F.when(source == "src2", chunk_id).alias("id"),
            F.when(source == "src6", F.concat(F.lit("00"), doc_id))
            .otherwise(unless(["src3", "src9"], doc_id.cast("string")))
            .alias("doc_id"),
            F.when(source == "src5", "0")
            .when(source == "src8", "many")
            .otherwise(F.col("n_chars").cast("string"))
            .alias("chunk_len"),
        )
    )
    value = (
        F.when(source == "src0", F.concat(F.lit("{"), body))
        .when(source == "src7", "")
        .otherwise(body)
    )
    return text_table(spark, sf_dir, "documents").select(value.alias("value"))


@query("""SELECT 'c' || doc_id AS chunk_id, CAST(doc_id AS VARCHAR) AS doc_id,
      CAST(CASE WHEN source = 'src5' THEN length(text) ELSE n_chars END AS BIGINT) AS chunk_len,
      md5(text) AS chunk_hash FROM documents
    WHERE source NOT IN ('src0', 'src3', 'src4', 'src7', 'src8', 'src9')""")
def embed_stage_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = prepare_for_embedding(chunk_messages(spark, sf_dir)).where("has_ids")
    return ready.select(
        "chunk_id",
        "doc_id",
        F.col("chunk_len").cast("bigint").alias("chunk_len"),
        F.md5("chunk").alias("chunk_hash"),
    )


@query("""SELECT 'completed' AS status,
      CAST(count(*) FILTER (source NOT IN ('src0', 'src4', 'src7', 'src8')) AS BIGINT) AS processed,
      CAST(count(*) FILTER (source NOT IN ('src0', 'src3', 'src4', 'src7', 'src8', 'src9')) AS BIGINT)
        AS chunks_count,
      CAST(count(*) FILTER (source IN ('src0', 'src8')) AS BIGINT) AS dead_lettered FROM documents""")
def embed_run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_run(prepare_for_embedding(chunk_messages(spark, sf_dir)))


# The messages of both stages: chunks to embed (ingestion) and embedded chunks (upload-index).
@query(f"""{VALIDATED_SQL}, messages AS (
      SELECT 'upload-index' AS subscription, reason IS NOT NULL AS dead FROM checked
      UNION ALL SELECT 'ingestion', source IN ('src0', 'src8') FROM documents)
    SELECT subscription, CAST(count(*) FILTER (NOT dead) AS BIGINT) AS active_messages,
      CAST(count(*) FILTER (dead) AS BIGINT) AS dead_letter_messages,
      CAST(0 AS BIGINT) AS transfer_dead_letter_messages,
      CAST(count(*) AS BIGINT) AS total_messages FROM messages GROUP BY ROLLUP (subscription)""")
def topic_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of written topics and of what their stages set aside, checked as they are read."""
    folder = scratch_folder(spark, "topics")
    sides = []
    for name, messages, check in (
        ("ingestion", chunk_messages(spark, sf_dir), prepare_for_embedding),
        ("upload-index", embedded_messages(spark, sf_dir), validate_embedded),
    ):
        publish(messages, f"{folder}/{name}")
        checked = check(receive(spark, f"{folder}/{name}"))
        status = F.when(F.col("reason").isNull(), "active").otherwise("dead-lettered")
        sides.append(checked.select(F.lit(name).alias("subscription"), status.alias("status")))
    return statistics(sides[0].unionByName(sides[1]))


# src0 can never be handled, src1 not at first, and src2 not passed on.
@query("""WITH settled AS (SELECT CASE source WHEN 'src0' THEN 'dead-lettered' WHEN 'src2' THEN 'transfer-dead-lettered'
        ELSE 'completed' END AS status, CASE source WHEN 'src0' THEN 3 WHEN 'src2' THEN 3 WHEN 'src1' THEN 2 ELSE 1 END AS n
      FROM documents)
    SELECT status, CAST(count(*) AS BIGINT) AS messages, CAST(sum(n) AS BIGINT) AS deliveries FROM settled GROUP BY status""")
def delivery_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by status after up to three deliveries, some of which fail."""
    folder = scratch_folder(spark, "deliveries")
    rows = text_table(spark, sf_dir, "documents")
    publish(rows.select(F.to_json(F.struct("doc_id", "source", "text")).alias("value")), f"{folder}/topic")

    def handle(batch: DataFrame) -> DataFrame:
        source = F.get_json_object("value", "$.source")
        error = F.when(source == "src0", "Invalid").when((source == "src1") & (F.col("delivery") == 1), "Busy")
        return batch.select(
            "message_id", F.coalesce(error, F.when(source == "src2", "Unreachable")).alias("error"),
            (source == "src2").alias("transfer"),
        )

    settled = deliver(spark, f"{folder}/topic", folder, handle, max_deliveries=3)
    return settled.groupBy("status").agg(
        F.count(F.lit(1)).alias("messages"), F.sum("deliveries").cast("bigint").alias("deliveries")
    )


@query("""WITH good AS (SELECT vec_id, label FROM embeddings
      WHERE label IN (7, 8) OR label = 9 AND vec_id % 10 NOT BETWEEN 1 AND 4),
    named AS (SELECT CASE WHEN label = 8 THEN CAST(vec_id AS VARCHAR) ELSE 'v' || vec_id END AS chunk_id FROM good)
    SELECT chunk_id FROM named ORDER BY chunk_id LIMIT 40""")
def bounded_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 good messages that a drain of a topic with a bound puts into an index, the first by chunk_id."""
    folder = scratch_folder(spark, "drain")
    # The ids of 23 digits are in other queries: here an id is its vector's.
    plain = embedded_messages(spark, sf_dir).where(~F.col("value").contains(LONG_ID))
    publish(plain, f"{folder}/upload-index")
    build_index_from_topic(
        spark, f"{folder}/upload-index", f"{folder}/index", max_messages=40, num_centroids=4, max_samples=40
    )
    return open_index(spark, f"{folder}/index").vectors().select("chunk_id")


@query(f"""{VALIDATED_SQL} SELECT 'completed' AS status, CAST(count(*) AS BIGINT) AS total_chunks,
      false AS is_running, CAST(NULL AS VARCHAR) AS error_message FROM checked WHERE reason IS NULL
    UNION ALL SELECT 'failed', 0, false, 'ValueError: no messages left'""")
def recorded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that counts the good messages, and one that fails, as the run table has them."""
    folder = scratch_folder(spark, "runs")
    checked = validate_embedded(embedded_messages(spark, sf_dir))
    with RunRecord(spark, folder, "index") as run:
        run.chunks = checked.where("reason is null").count()
    try:
        with RunRecord(spark, folder, "index"):
            if checked.where("reason = 'none such'").isEmpty():
                raise ValueError("no messages left")
    except ValueError:
        pass
    return RunRecord.report(spark, folder).select("status", "total_chunks", "is_running", "error_message")


@query("""SELECT 'c' || doc_id AS chunk_id, CAST(doc_id AS VARCHAR) AS doc_id,
      CAST(CASE WHEN source = 'src5' THEN length(text) ELSE n_chars END AS BIGINT) AS chunk_len,
      md5(text) AS chunk_hash, 64 AS dim FROM documents
    WHERE source NOT IN ('src0', 'src3', 'src4', 'src7', 'src8', 'src9')""")
def logged_embed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks sent to a topic by two senders, embedded as a stream by offsets, sent on, and read back."""
    folder = scratch_folder(spark, "log")
    messages = chunk_messages(spark, sf_dir)
    even = F.xxhash64("value") % 2 == 0
    send(messages.where(even), f"{folder}/ingestion", "even")
    send(messages.where(~even), f"{folder}/ingestion", "odd")
    embed_topic(
        spark,
        stream_log(spark, f"{folder}/ingestion", "embedder"),
        lambda embedded, batch: send(embedded, f"{folder}/upload-index", "embedder", batch),
        f"{folder}/dead",
        f"{folder}/checkpoint",
    ).awaitTermination()
    checked = validate_embedded(read_log(spark, f"{folder}/upload-index")).where(F.col("reason").isNull())
    return checked.select(
        "chunk_id",
        "doc_id",
        F.col("chunk_len").cast("bigint").alias("chunk_len"),
        F.md5("chunk").alias("chunk_hash"),
        F.size("embedding").alias("dim"),
    )


@query("""SELECT 'fresh' AS subscription, CAST(count(*) AS BIGINT) AS total_messages,
      CAST(count(*) AS BIGINT) AS active_messages FROM documents
    UNION ALL SELECT 'reader', count(*), count(*) FILTER (lang IS DISTINCT FROM 'en') FROM documents
    UNION ALL SELECT 'read', count(*), count(*) FROM documents WHERE lang IS DISTINCT FROM 'en'""")
def log_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two subscriptions have left of a topic, by its entries; and what is read after the first one's cursor."""
    folder = scratch_folder(spark, "log")
    rows = text_table(spark, sf_dir, "documents")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    for part in (english, ~english):
        send(rows.where(part).select(F.to_json(F.struct("doc_id", "text")).alias("value")), folder)
    acknowledge(spark, folder, "reader", {"main": 1})
    left = read_log(spark, folder, {"main": 1}).agg(F.count(F.lit(1)).alias("n"))
    return backlog(spark, folder, ["fresh", "reader"]).unionByName(
        left.select(F.lit("read").alias("subscription"), F.col("n").alias("total_messages"), F.col("n").alias("active_messages"))
    )
