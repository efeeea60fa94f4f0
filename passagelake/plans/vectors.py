"""Queries over the embeddings table: sampling, centroids, shards, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from passagelake.functions.ids import object_path, shard_name
from passagelake.functions.vectors import cosine, inner_product, l2_distance
from passagelake.operators.centroids import (
    NUM_CENTROIDS,
    assign_nearest,
    group_centroids,
    lloyd_steps,
    route,
    train_centroids,
)
from passagelake.operators.bounds import bounded_topk as open_by_bounds
from passagelake.operators.centroid_tree import assign_tree, build_tree, route_tree, train_leaves
from passagelake.operators.graph import build_graph, search_graph
from passagelake.operators.labels import dense_labels
from passagelake.operators.quantise import quantise, search_quantised, train_codebooks
from passagelake.operators.sampling import sample_rows
from passagelake.operators.search import (
    recall_at_k as recall,
    search_vectors,
    shard_topk as search_shards,
)
from passagelake.plans.catalog import query, table
from passagelake.session import reliable
from passagelake.sources.index_store import index_summary as summarize, shard_metadata as describe


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("chunk_id"), "embedding", F.col("label").alias("topic")
    )


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector per label: centroids that SQL can compute as well."""
    return reliable(group_centroids(vectors(spark, sf_dir), "topic"))


def assigned(spark: SparkSession, sf_dir: str, centres: DataFrame | None = None) -> DataFrame:
    centres = centroids(spark, sf_dir) if centres is None else centres
    return assign_nearest(vectors(spark, sf_dir), centres)


def mean_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries from the whole table: the mean of each label's vectors by id hash digit."""
    rows = vectors(spark, sf_dir).withColumn(
        "query_id", F.concat_ws("-", "topic", F.substring(F.md5("chunk_id"), 1, 1))
    )
    means = reliable(group_centroids(rows, "query_id"))
    return means.select(F.col("centroid_idx").alias("query_id"), F.col("centroid").alias("embedding"))


# Components of vectors, centroids and queries as rows (id, dimension, number).
PARTS_SQL = """v AS (SELECT CAST(vec_id AS VARCHAR) AS chunk_id, label AS topic,
        CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    vp AS (SELECT chunk_id, topic, generate_subscripts(e, 1) AS d, unnest(e) AS x FROM v),
    cp AS (SELECT topic AS centroid_idx, d, avg(x) AS x FROM vp GROUP BY topic, d),
    c AS (SELECT centroid_idx, list(x ORDER BY d) AS e FROM cp GROUP BY centroid_idx),
    qp AS (SELECT topic || '-' || substring(md5(chunk_id), 1, 1) AS query_id, d, avg(x) AS x
      FROM vp GROUP BY ALL),
    q AS (SELECT query_id, list(x ORDER BY d) AS e FROM qp GROUP BY query_id),
    near AS (SELECT chunk_id, v.e, c.centroid_idx, list_distance(v.e, c.e) AS dist,
      row_number() OVER (PARTITION BY chunk_id ORDER BY round(list_distance(v.e, c.e), 9), c.centroid_idx) AS r
      FROM v, c),
    a AS (SELECT chunk_id, e, centroid_idx, dist FROM near WHERE r = 1),
    routes AS (SELECT query_id, q.e, c.centroid_idx, list_distance(q.e, c.e) AS dist,
      row_number() OVER (PARTITION BY query_id ORDER BY round(list_distance(q.e, c.e), 9), c.centroid_idx)
        AS probe FROM q, c)"""

SCORE = "list_inner_product({q}, {v}) / sqrt(list_inner_product({q}, {q}))"
SCORED_SQL = f"""scored AS (SELECT routes.query_id, a.chunk_id, a.centroid_idx,
      round({SCORE.format(q="routes.e", v="a.e")}, 9) AS score
      FROM routes JOIN a ON routes.centroid_idx = a.centroid_idx WHERE probe <= 3)"""
EXACT_SQL = f"""exact AS (SELECT query_id, chunk_id, round({SCORE.format(q="q.e", v="v.e")}, 9) AS score
      FROM q, v),
    best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
      FROM exact)"""
WITH = f"WITH {PARTS_SQL}"
HIT = "query_id, chunk_id, round(score, 6) + 0.0 AS score, CAST(rank AS BIGINT) AS rank"


def _hits(found: DataFrame, *more: str) -> DataFrame:
    return found.select(
        "query_id",
        "chunk_id",
        F.round("score", 6).alias("score"),
        F.col("rank").cast("bigint").alias("rank"),
        *more,
    )


@query("""WITH sample AS (SELECT CAST(vec_id AS VARCHAR) AS chunk_id, CAST(embedding AS DOUBLE[]) AS e
      FROM embeddings ORDER BY md5('42:' || vec_id), CAST(vec_id AS VARCHAR) LIMIT 100)
    SELECT chunk_id, CAST(generate_subscripts(e, 1) - 1 AS BIGINT) AS dim, unnest(e) AS number FROM sample""")
def sample_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = sample_rows(vectors(spark, sf_dir), "chunk_id", 100)
    numbers = sample.select("chunk_id", F.posexplode("embedding").alias("dim", "number"))
    return numbers.select(
        "chunk_id", F.col("dim").cast("bigint").alias("dim"), F.col("number").cast("double").alias("number")
    )


@query(f"""{WITH} SELECT CAST(centroid_idx AS BIGINT) AS centroid_idx, CAST(d - 1 AS BIGINT) AS dim,
      round(x, 6) + 0.0 AS number FROM cp""")
def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids(spark, sf_dir).select(
        F.col("centroid_idx").cast("bigint").alias("centroid_idx"),
        F.posexplode("centroid").alias("dim", "x"),
    ).select("centroid_idx", F.col("dim").cast("bigint").alias("dim"), F.round("x", 6).alias("number"))


@query(f"""{WITH} SELECT chunk_id, CAST(centroid_idx AS BIGINT) AS centroid_idx,
      round(dist, 6) + 0.0 AS centroid_distance FROM a""")
def assign_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(spark, sf_dir).select(
        "chunk_id",
        F.col("centroid_idx").cast("bigint").alias("centroid_idx"),
        F.round("centroid_distance", 6).alias("centroid_distance"),
    )


@query(f"""{WITH} SELECT query_id, CAST(probe AS BIGINT) AS probe,
      CAST(centroid_idx AS BIGINT) AS centroid_idx, round(dist, 6) + 0.0 AS centroid_distance
    FROM routes WHERE probe <= 3""")
def route_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = route(mean_queries(spark, sf_dir), centroids(spark, sf_dir))
    return routed.select(
        "query_id",
        F.col("probe").cast("bigint").alias("probe"),
        F.col("centroid_idx").cast("bigint").alias("centroid_idx"),
        F.round("centroid_distance", 6).alias("centroid_distance"),
    )


@query(f"""{WITH}, {SCORED_SQL}, best AS (SELECT *, row_number() OVER (
        PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored)
    SELECT {HIT}, CAST(centroid_idx AS BIGINT) AS centroid_idx FROM best WHERE rank <= 3""")
def routed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres = centroids(spark, sf_dir)
    found = search_vectors(mean_queries(spark, sf_dir), assigned(spark, sf_dir, centres), centres)
    return _hits(found, F.col("centroid_idx").cast("bigint").alias("centroid_idx"))


@query(f"""{WITH}, {SCORED_SQL}, best AS (SELECT *, row_number() OVER (
        PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored)
    SELECT {HIT}, CAST(centroid_idx AS BIGINT) AS centroid_idx FROM best WHERE rank <= 3""")
def joined_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the form for query sets too large to broadcast."""
    centres = centroids(spark, sf_dir)
    found = search_vectors(
        mean_queries(spark, sf_dir), assigned(spark, sf_dir, centres), centres, broadcast_numbers=0
    )
    return _hits(found, F.col("centroid_idx").cast("bigint").alias("centroid_idx"))


@query(f"""{WITH}, {SCORED_SQL}, best AS (SELECT *, row_number() OVER (
        PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored)
    SELECT {HIT}, CAST(centroid_idx AS BIGINT) AS centroid_idx FROM best WHERE rank <= 3""")
def streamed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the queries passing by the vectors in several blocks: no vector is shuffled."""
    centres = centroids(spark, sf_dir)
    shards = reliable(assigned(spark, sf_dir, centres))
    found = search_vectors(mean_queries(spark, sf_dir), shards, centres, broadcast_numbers=64 * 3 * 60)
    return _hits(found, F.col("centroid_idx").cast("bigint").alias("centroid_idx"))


@query(f"""{WITH}, {SCORED_SQL}, best AS (SELECT *, row_number() OVER (
        PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored)
    SELECT {HIT}, CAST(centroid_idx AS BIGINT) AS centroid_idx FROM best WHERE rank <= 3""")
def quantised_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a scan of codes: only rows that their bounds cannot rule out are scored in full."""
    centres = centroids(spark, sf_dir)
    shards = reliable(dense_labels(reliable(assigned(spark, sf_dir, centres))))
    books = train_codebooks(shards)
    codes = reliable(quantise(shards, books))
    found = search_quantised(mean_queries(spark, sf_dir), codes, shards, centres, books, exact=True)
    return _hits(found, F.col("centroid_idx").cast("bigint").alias("centroid_idx"))


@query(f"""{WITH}, {SCORED_SQL}, best AS (SELECT *, row_number() OVER (
        PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored)
    SELECT {HIT}, CAST(centroid_idx AS BIGINT) AS centroid_idx FROM best WHERE rank <= 3""")
def graph_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by walks through a graph of near neighbours: exact scores, and no row missed here."""
    centres = centroids(spark, sf_dir)
    graph = reliable(build_graph(reliable(dense_labels(reliable(assigned(spark, sf_dir, centres))))))
    found = search_graph(mean_queries(spark, sf_dir), graph, centres)
    return _hits(found, F.col("centroid_idx").cast("bigint").alias("centroid_idx"))


@query(f"""{WITH}, {SCORED_SQL}, best AS (SELECT *, row_number() OVER (
        PARTITION BY query_id, centroid_idx ORDER BY score DESC, chunk_id) AS rank FROM scored)
    SELECT {HIT}, CAST(centroid_idx AS BIGINT) AS centroid_idx FROM best WHERE rank <= 5""")
def shard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres = centroids(spark, sf_dir)
    found = search_shards(mean_queries(spark, sf_dir), assigned(spark, sf_dir, centres), centres)
    return _hits(found, F.col("centroid_idx").cast("bigint").alias("centroid_idx"))


def _search_all(spark: SparkSession, sf_dir: str, centres: DataFrame) -> DataFrame:
    shards = assign_nearest(vectors(spark, sf_dir), centres)
    return search_vectors(mean_queries(spark, sf_dir), shards, centres, nprobe=1_000_000)


@query(f"{WITH}, {EXACT_SQL} SELECT {HIT} FROM best WHERE rank <= 3")
def exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probing every shard makes the search exact."""
    return _hits(_search_all(spark, sf_dir, centroids(spark, sf_dir)))


@query(f"{WITH}, {EXACT_SQL} SELECT {HIT} FROM best WHERE rank <= 3")
def bounded_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact as well: shards are opened until the bounds say that no other can improve a query."""
    rows = vectors(spark, sf_dir)
    centres = reliable(train_centroids(rows))
    shards = reliable(assign_nearest(rows, centres))
    return _hits(open_by_bounds(mean_queries(spark, sf_dir), shards, centres)[0])


@query(f"{WITH}, {EXACT_SQL} SELECT {HIT} FROM best WHERE rank <= 3")
def kmeans_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through trained centroids: whatever they are, no vector may be lost."""
    return _hits(_search_all(spark, sf_dir, train_centroids(vectors(spark, sf_dir))))


@query(f"""{WITH}, {SCORED_SQL}, {EXACT_SQL}, found AS (SELECT *, row_number() OVER (
        PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored),
    per_query AS (SELECT b.query_id, avg(CASE WHEN f.chunk_id IS NULL THEN 0.0 ELSE 1.0 END) AS recall
      FROM best b LEFT JOIN found f ON b.query_id = f.query_id AND b.chunk_id = f.chunk_id AND f.rank <= 3
      WHERE b.rank <= 3 GROUP BY b.query_id)
    SELECT CAST(count(*) AS BIGINT) AS queries, round(avg(recall), 6) + 0.0 AS recall FROM per_query""")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, centres = mean_queries(spark, sf_dir), centroids(spark, sf_dir)
    shards = assigned(spark, sf_dir, centres)
    routed = search_vectors(asked, shards, centres)
    exact = search_vectors(asked, shards, centres, nprobe=1_000_000)
    return recall(routed, exact).select("queries", F.round("recall", 6).alias("recall"))


@query("""SELECT CAST(count(*) AS BIGINT) AS num_vectors, CAST(count(*) AS BIGINT) AS at_nearest,
      CAST(least(30, count(DISTINCT embedding)) AS BIGINT) AS num_centroids FROM embeddings""")
def kmeans_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards under trained centroids, as what must hold of them: no vector lost, each at its nearest."""
    rows = vectors(spark, sf_dir)
    centres = reliable(train_centroids(rows))
    shards = assign_nearest(rows, centres)
    # Routing to all 30 gives the distances that the assigned one is held against.
    asked = rows.select("embedding", F.col("chunk_id").alias("query_id"))
    routed = route(asked, centres, nprobe=NUM_CENTROIDS)
    gaps = shards.select("chunk_id", F.col("centroid_distance").alias("_own")).join(
        routed.select(F.col("query_id").alias("chunk_id"), F.col("centroid_distance").alias("_gap")), "chunk_id"
    )
    least = gaps.groupBy("chunk_id", "_own").agg(F.min("_gap").alias("_least"))
    near = F.abs(F.col("_own") - F.col("_least")) < 1e-6
    return least.agg(
        F.count(F.lit(1)).alias("num_vectors"),
        F.count_if(near).alias("at_nearest"),
        F.lit(centres.count()).cast("bigint").alias("num_centroids"),
    )


# The queries as centroids, numbered by their names.
TREE_SQL = f"""{WITH}, t AS (SELECT row_number() OVER (ORDER BY query_id) - 1 AS i, e FROM q),
    near_t AS (SELECT chunk_id, i, list_distance(v.e, t.e) AS dist, row_number() OVER (
      PARTITION BY chunk_id ORDER BY round(list_distance(v.e, t.e), 9), i) AS probe FROM v, t)"""


def _numbered_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    # As many rows as labels and hash digits.
    order = Window.orderBy("query_id")
    return mean_queries(spark, sf_dir).select(
        (F.row_number().over(order) - 1).alias("centroid_idx"), F.col("embedding").alias("centroid")
    )


@query(f"""{TREE_SQL} SELECT chunk_id, CAST(probe AS BIGINT) AS probe, CAST(i AS BIGINT) AS centroid_idx,
      round(dist, 6) + 0.0 AS centroid_distance FROM near_t WHERE probe <= 3""")
def tree_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest of many centroids, through a tree whose bounds lose none."""
    routed = route_tree(vectors(spark, sf_dir), build_tree(_numbered_means(spark, sf_dir)))
    return routed.select(
        "chunk_id",
        F.col("probe").cast("bigint").alias("probe"),
        F.col("centroid_idx").cast("bigint").alias("centroid_idx"),
        F.round("centroid_distance", 6).alias("centroid_distance"),
    )


@query("""SELECT CAST(count(*) AS BIGINT) AS num_vectors, CAST(count(*) AS BIGINT) AS at_nearest FROM embeddings""")
def tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards under leaves trained by k-means of k-means: no vector lost, each at its nearest."""
    rows = vectors(spark, sf_dir)
    leaves = train_leaves(rows, 4 * NUM_CENTROIDS)
    own = assign_tree(rows, build_tree(leaves)).select("chunk_id", F.col("centroid_distance").alias("_own"))
    flat = assign_nearest(rows, leaves).select("chunk_id", "centroid_distance")
    return own.join(flat, "chunk_id").agg(
        F.count(F.lit(1)).alias("num_vectors"),
        F.count_if(F.abs(F.col("_own") - F.col("centroid_distance")) < 1e-6).alias("at_nearest"),
    )


LLOYD_CENTRES = 5


def _lloyd_sql(step: int) -> str:
    """CTEs of one Lloyd step: the vectors nearest to each centre, and their means."""
    return f"""n{step} AS (SELECT v.chunk_id, v.e, k.i, row_number() OVER (PARTITION BY v.chunk_id
        ORDER BY list_distance(v.e, k.e), k.i) AS r FROM v, k{step - 1} k),
      p{step} AS (SELECT i, generate_subscripts(e, 1) AS d, unnest(e) AS x FROM n{step} WHERE r = 1),
      m{step} AS (SELECT i, list(x ORDER BY d) AS e FROM (SELECT i, d, avg(x) AS x FROM p{step} GROUP BY i, d)
        GROUP BY i),
      k{step} AS (SELECT k.i, coalesce(m.e, k.e) AS e FROM k{step - 1} k LEFT JOIN m{step} m ON k.i = m.i)"""


@query(f"""WITH v AS (SELECT CAST(vec_id AS VARCHAR) AS chunk_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
      k0 AS (SELECT row_number() OVER (ORDER BY md5('42:' || chunk_id), chunk_id) - 1 AS i, e FROM v
        QUALIFY i < {LLOYD_CENTRES}), {_lloyd_sql(1)}, {_lloyd_sql(2)}, {_lloyd_sql(3)}
    SELECT CAST(i AS BIGINT) AS centroid_idx, CAST(generate_subscripts(e, 1) - 1 AS BIGINT) AS dim,
      round(unnest(e), 6) + 0.0 AS number FROM k3""")
def lloyd_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three Lloyd steps from seeded starts, over all vectors."""
    centres = lloyd_steps(vectors(spark, sf_dir), LLOYD_CENTRES, 3)
    numbers = centres.select("centroid_idx", F.posexplode("centroid").alias("dim", "x"))
    return numbers.select(
        F.col("centroid_idx").cast("bigint").alias("centroid_idx"),
        F.col("dim").cast("bigint").alias("dim"),
        F.round("x", 6).alias("number"),
    )


@query(f"""{WITH} SELECT chunk_id, CAST(centroid_idx AS BIGINT) AS centroid_idx,
      CAST(row_number() OVER (PARTITION BY centroid_idx ORDER BY md5(chunk_id), chunk_id) - 1 AS BIGINT) AS label
    FROM a""")
def shard_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Stored first: labelling counts before it numbers, and must not assign twice.
    labelled = dense_labels(reliable(assigned(spark, sf_dir).select("chunk_id", "centroid_idx")))
    return labelled.select(
        "chunk_id", F.col("centroid_idx").cast("bigint").alias("centroid_idx"), "label"
    )


def _sizes(spark: SparkSession, sf_dir: str, centres: DataFrame) -> DataFrame:
    shards = assigned(spark, sf_dir, centres).groupBy("centroid_idx")
    return shards.agg(F.count(F.lit(1)).alias("num_vectors"))


@query(f"""{WITH} SELECT 'shard_' || lpad(CAST(centroid_idx AS VARCHAR), 3, '0') AS shard_id,
      CAST(centroid_idx AS BIGINT) AS centroid_index, CAST(max(len(e)) AS BIGINT) AS embedding_dim,
      CAST(count(*) AS BIGINT) AS num_vectors, count(*) > 50000 AS over_limit,
      'base/shards/shard_' || lpad(CAST(centroid_idx AS VARCHAR), 3, '0') || '/vectors' AS vectors_path,
      'v1' AS version FROM a GROUP BY centroid_idx""")
def shard_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres = centroids(spark, sf_dir)
    described = describe(_sizes(spark, sf_dir, centres), centres, base_path="base/")
    return described.select(
        "shard_id",
        F.col("centroid_index").cast("bigint").alias("centroid_index"),
        F.col("embedding_dim").cast("bigint").alias("embedding_dim"),
        "num_vectors",
        "over_limit",
        F.col("paths.vectors").alias("vectors_path"),
        "version",
    )


@query(f"""{WITH}, s AS (SELECT centroid_idx, count(*) AS n FROM a GROUP BY centroid_idx)
    SELECT 'completed' AS status, CAST(count(*) AS BIGINT) AS num_shards,
      string_agg('shard_' || lpad(CAST(centroid_idx AS VARCHAR), 3, '0') || '=' || n, ','
        ORDER BY centroid_idx) AS shards FROM s""")
def index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres = centroids(spark, sf_dir)
    described = describe(_sizes(spark, sf_dir, centres), centres, base_path="base")
    entry = lambda s: F.concat(s["shard_id"], F.lit("="), s["num_vectors"])
    return summarize(described).select(
        "status", "num_shards", F.array_join(F.transform("shards", entry), ",").alias("shards")
    )


@query("""SELECT CAST(vec_id AS VARCHAR) AS chunk_id, 'shard_' || lpad(CAST(label AS VARCHAR), 3, '0') AS shard_id,
      'client/shards/shard_' || lpad(CAST(label AS VARCHAR), 3, '0') || '/meta.json' AS path FROM embeddings""")
def shard_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    shard = shard_name(F.col("topic"))
    return vectors(spark, sf_dir).select(
        "chunk_id",
        shard.alias("shard_id"),
        object_path(F.lit("client//"), F.lit("/shards/"), shard, F.lit("meta.json")).alias("path"),
    )


# Distances between each vector and its label's mean, by the column functions.
@query(f"""{WITH} SELECT chunk_id, round(list_distance(v.e, c.e), 6) + 0.0 AS l2,
      round(list_inner_product(v.e, c.e), 6) + 0.0 AS inner_product,
      round(list_cosine_similarity(v.e, c.e), 6) + 0.0 AS cosine
    FROM v JOIN c ON v.topic = c.centroid_idx""")
def vector_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One centroid per label.
    joined = vectors(spark, sf_dir).join(
        F.broadcast(centroids(spark, sf_dir)), F.col("topic") == F.col("centroid_idx")
    )
    pair = F.col("embedding"), F.col("centroid")
    return joined.select(
        "chunk_id",
        F.round(l2_distance(*pair), 6).alias("l2"),
        F.round(inner_product(*pair), 6).alias("inner_product"),
        F.round(cosine(*pair), 6).alias("cosine"),
    )
