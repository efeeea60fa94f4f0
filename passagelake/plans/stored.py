"""Queries that embed passages, store them as an index, stream into it and search it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from passagelake.functions.embed import HashingEmbedder, embed_column
from passagelake.operators.centroids import group_centroids
from passagelake.operators.reports import PREVIEW_ROWS, embedding_preview as preview_rows
from passagelake.plans.catalog import query, table
from passagelake.plans.messages import embedded_messages
from passagelake.plans.passages import DOCUMENTS_SQL, LINES, chunk_sql, document_chunks
from passagelake.plans.vectors import PARTS_SQL, centroids
from passagelake.session import reliable, scratch_folder
from passagelake.sources.index_store import (
    VectorIndex,
    build_index,
    build_index_from_topic,
    compact_index,
    create_empty_index,
    open_index,
    write_centroids,
    write_index_metadata,
)
from passagelake.sources.topics import CHUNK_FIELDS, publish, to_messages
from passagelake.streaming.stages import embed_topic, index_topic

MODEL = "hashing-64"

TOKENS = "unnest(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'))"


def _embed_sql(name: str, source: str, key: str, text: str) -> str:
    """CTE ``name`` (key, b, x): the non-zero numbers of each text's vector."""
    return f"""{name}_tokens AS (SELECT {key}, {TOKENS.format(text=text)} AS t FROM {source}),
    {name}_cells AS (SELECT {key}, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64 AS b, count(*) AS n
      FROM {name}_tokens WHERE t <> '' GROUP BY ALL),
    {name} AS (SELECT {key}, b, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS FLOAT) AS DOUBLE) AS x
      FROM {name}_cells)"""


CHUNKS_SQL = f"WITH {chunk_sql(DOCUMENTS_SQL, LINES)}, {_embed_sql('v', 'chunks', 'chunk_id', 'chunk')}"

# Centroids are the mean vectors of the sources; squared distances from products.
SHARDS_SQL = f"""{CHUNKS_SQL},
    sizes AS (SELECT CAST(substr(source_file, 4) AS INT) AS centroid_idx, count(*) AS n FROM chunks GROUP BY 1),
    c AS (SELECT CAST(substr(source_file, 4) AS INT) AS centroid_idx, b, sum(x) / any_value(n) AS x
      FROM v JOIN chunks USING (chunk_id) JOIN sizes ON centroid_idx = CAST(substr(source_file, 4) AS INT)
      GROUP BY 1, b),
    c2 AS (SELECT centroid_idx, sum(x * x) AS s FROM c GROUP BY centroid_idx),
    vc AS (SELECT chunk_id, centroid_idx, sum(v.x * c.x) AS p FROM v JOIN c USING (b) GROUP BY ALL),
    near AS (SELECT chunks.chunk_id, c2.centroid_idx, row_number() OVER (PARTITION BY chunks.chunk_id
        ORDER BY round(c2.s - 2 * coalesce(vc.p, 0), 12), c2.centroid_idx) AS r
      FROM chunks CROSS JOIN c2 LEFT JOIN vc ON vc.chunk_id = chunks.chunk_id AND vc.centroid_idx = c2.centroid_idx),
    a AS (SELECT chunk_id, centroid_idx FROM near WHERE r = 1)"""

SEARCH_SQL = f"""{SHARDS_SQL},
    {_embed_sql('q', 'benchmark', 'item_id', 'text')},
    qc AS (SELECT item_id, centroid_idx, sum(q.x * c.x) AS p FROM q JOIN c USING (b) GROUP BY ALL),
    routes AS (SELECT item_id, c2.centroid_idx, row_number() OVER (PARTITION BY item_id
        ORDER BY round(c2.s - 2 * coalesce(qc.p, 0), 12), c2.centroid_idx) AS probe
      FROM (SELECT DISTINCT item_id FROM q) CROSS JOIN c2 LEFT JOIN qc USING (item_id, centroid_idx)),
    q2 AS (SELECT item_id, sqrt(sum(x * x)) AS norm FROM q GROUP BY item_id),
    dots AS (SELECT q.item_id, v.chunk_id, sum(q.x * v.x) AS p FROM q JOIN v USING (b) GROUP BY ALL),
    scored AS (SELECT routes.item_id, a.chunk_id, round(coalesce(dots.p, 0) / norm, 9) AS score
      FROM routes JOIN a ON routes.centroid_idx = a.centroid_idx AND probe <= 3 JOIN q2 USING (item_id)
      LEFT JOIN dots ON dots.item_id = routes.item_id AND dots.chunk_id = a.chunk_id),
    best AS (SELECT item_id AS query_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id)
        AS rank, chunk_id, score FROM scored),
    results AS (SELECT query_id, rank, chunk_id, doc_id, score, chunk AS text
      FROM best JOIN chunks USING (chunk_id) WHERE rank <= 3)"""


def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the documents with vectors, as a stored table: the model runs once."""
    chunks = document_chunks(spark, sf_dir)
    vectors = embed_column(F.col("chunk"), HashingEmbedder, MODEL)
    folder = scratch_folder(spark, "embedded")
    chunks.withColumn("embedding", vectors).write.parquet(folder)
    return spark.read.parquet(folder)


def source_centroids(embedded: DataFrame) -> DataFrame:
    numbered = embedded.withColumn("source_no", F.substring("source_file", 4, 9).cast("int"))
    return reliable(group_centroids(numbered, "source_no"))


def stored_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """An index of all passages, with one shard per source mean."""
    path = scratch_folder(spark, "index")
    embedded = embedded_chunks(spark, sf_dir)
    build_index(embedded, path, centroids=source_centroids(embedded))
    return open_index(spark, path)


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")
    return items.withColumn("embedding", embed_column(F.col("text"), HashingEmbedder, MODEL))


def search_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_index(spark, sf_dir).search(benchmark_queries(spark, sf_dir))


@query(f"{CHUNKS_SQL} SELECT chunk_id, CAST(b AS BIGINT) AS dim, round(x, 6) + 0.0 AS number FROM v")
def embed_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = document_chunks(spark, sf_dir)
    vectors = embed_column(F.col("chunk"), HashingEmbedder, MODEL)
    numbers = chunks.withColumn("embedding", vectors).select(
        "chunk_id", F.posexplode("embedding").alias("dim", "x")
    )
    return numbers.where(F.col("x") != 0).select(
        "chunk_id",
        F.col("dim").cast("bigint").alias("dim"),
        F.round(F.col("x").cast("double"), 6).alias("number"),
    )


@query(f"""WITH {chunk_sql(DOCUMENTS_SQL, LINES)} SELECT chunk_id, doc_id, CAST(64 AS BIGINT) AS embedding_dimensions
    FROM (SELECT *, row_number() OVER (ORDER BY chunk_id) AS place FROM chunks) WHERE place <= 50""")
def embedding_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The rows to show are chosen first, so that only they are embedded.
    first = document_chunks(spark, sf_dir).orderBy("chunk_id").limit(PREVIEW_ROWS)
    embedded = first.withColumn("embedding", embed_column(F.col("chunk"), HashingEmbedder, MODEL))
    return preview_rows(embedded).withColumn(
        "embedding_dimensions", F.col("embedding_dimensions").cast("bigint")
    )


@query(f"""{SEARCH_SQL} SELECT query_id, CAST(rank AS BIGINT) AS rank, chunk_id, doc_id,
      round(score, 6) + 0.0 AS score, text FROM results""")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_benchmark(spark, sf_dir).select(
        "query_id",
        F.col("rank").cast("bigint").alias("rank"),
        "chunk_id",
        "doc_id",
        F.round("score", 6).alias("score"),
        "text",
    )


@query(f"""{SHARDS_SQL} SELECT 'shard_' || lpad(CAST(centroid_idx AS VARCHAR), 3, '0') AS shard_id,
      CAST(count(*) AS BIGINT) AS num_vectors, CAST(0 AS BIGINT) AS first_label,
      CAST(count(*) - 1 AS BIGINT) AS last_label, CAST(count(*) AS BIGINT) AS labels
    FROM a GROUP BY centroid_idx""")
def stored_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shard_rows(stored_index(spark, sf_dir).vectors())


def _shard_rows(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("centroid_idx").agg(
        F.count(F.lit(1)).alias("num_vectors"),
        F.min("label").alias("first_label"),
        F.max("label").alias("last_label"),
        F.count_distinct("label").alias("labels"),
    ).select(
        F.format_string("shard_%03d", "centroid_idx").alias("shard_id"),
        "num_vectors",
        "first_label",
        "last_label",
        "labels",
    )


@query(f"""{SHARDS_SQL} SELECT 'shard_' || lpad(CAST(centroid_idx AS VARCHAR), 3, '0') AS shard_id,
      CAST(count(*) AS BIGINT) AS num_vectors, CAST(0 AS BIGINT) AS first_label,
      CAST(count(*) - 1 AS BIGINT) AS last_label, CAST(count(*) AS BIGINT) AS labels
    FROM a GROUP BY centroid_idx""")
def stream_embed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same index filled by streams: topic of passages, embed, topic of vectors, append."""
    return _shard_rows(streamed_index(spark, sf_dir).vectors())


def streamed_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    folder = scratch_folder(spark, "stream")
    embedded = embedded_chunks(spark, sf_dir)
    publish(to_messages(embedded, CHUNK_FIELDS), f"{folder}/ingestion")
    embed_topic(
        spark,
        f"{folder}/ingestion",
        f"{folder}/upload-index",
        f"{folder}/embed-dead-letters",
        f"{folder}/embed-checkpoint",
        model_key=MODEL,
    ).awaitTermination()
    centres = source_centroids(embedded)
    path = f"{folder}/index"
    create_empty_index(spark, path)
    write_centroids(spark, path, 1, centres)
    write_index_metadata(spark, path, 1, centres.count())
    index = open_index(spark, path)
    index_topic(
        spark,
        f"{folder}/upload-index",
        index,
        f"{folder}/index-dead-letters",
        f"{folder}/index-checkpoint",
    ).awaitTermination()
    return index


SIZES = f"""{SHARDS_SQL} SELECT 'shard_' || lpad(CAST(centroid_idx AS VARCHAR), 3, '0') AS shard_id,
      CAST(count(*) AS BIGINT) AS num_vectors, CAST(0 AS BIGINT) AS first_label,
      CAST(count(*) - 1 AS BIGINT) AS last_label, CAST(count(*) AS BIGINT) AS labels
    FROM a GROUP BY centroid_idx"""


@query(SIZES)
def compacted_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored index, compacted into a new version: the same shards and labels."""
    return _shard_rows(compact_index(stored_index(spark, sf_dir)).vectors())


@query(f"""{SHARDS_SQL} SELECT 'shard_' || lpad(CAST(centroid_idx AS VARCHAR), 3, '0') AS shard_id,
      CAST(centroid_idx AS BIGINT) AS centroid_index, CAST(64 AS BIGINT) AS embedding_dim,
      CAST(count(*) AS BIGINT) AS num_vectors, count(*) > 50000 AS over_limit FROM a GROUP BY centroid_idx""")
def streamed_shard_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard metadata of an index that only streams have filled."""
    return streamed_index(spark, sf_dir).shard_metadata().select(
        "shard_id",
        F.col("centroid_index").cast("bigint").alias("centroid_index"),
        F.col("embedding_dim").cast("bigint").alias("embedding_dim"),
        "num_vectors",
        "over_limit",
    )


# Messages of the embeddings table, some of them broken (see the message queries).
@query(f"""WITH {PARTS_SQL} SELECT 'shard_' || lpad(CAST(centroid_idx AS VARCHAR), 3, '0') AS shard_id,
      CAST(count(*) AS BIGINT) AS num_vectors FROM a JOIN v USING (chunk_id)
    WHERE topic IN (7, 8) OR topic = 9 AND CAST(chunk_id AS BIGINT) % 10 NOT BETWEEN 1 AND 3 GROUP BY centroid_idx""")
def topic_to_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drain a topic of embedded chunks, bad ones among them, into an index."""
    folder = scratch_folder(spark, "topic")
    publish(embedded_messages(spark, sf_dir), f"{folder}/upload-index")
    build_index_from_topic(
        spark, f"{folder}/upload-index", f"{folder}/index", centroids=centroids(spark, sf_dir)
    )
    return open_index(spark, f"{folder}/index").shard_sizes().select(
        F.format_string("shard_%03d", "centroid_idx").alias("shard_id"), "num_vectors"
    )
