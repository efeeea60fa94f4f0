"""The vector index as tables: centroids, vectors by shard, shard and index metadata.

Layout below the index path::

    centroids/index_version=V/
    vectors/index_version=V/batch_id=B/centroid_idx=C/
    shard_counts/index_version=V/batch_id=B/
    graph/index_version=V/centroid_idx=C/   neighbour lists beside vectors, if built
    codes/index_version=V/centroid_idx=C/, codebooks/index_version=V/   quantised vectors, if built
    index_metadata/                     one row per finished version

A version is readable once its index_metadata row is there, which is written
last. Rebuilding makes a new version; readers of an old one are not disturbed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from passagelake.functions.ids import object_path, shard_name
from passagelake.operators.centroids import assign_nearest, train_centroids
from passagelake.operators.graph import build_graph, search_graph
from passagelake.operators.labels import dense_labels
from passagelake.operators.quantise import CODES, Codebooks, quantise, search_quantised, train_codebooks
from passagelake.operators.search import attach_passages, search_passages
from passagelake.operators.validation import validate_embedded
from passagelake.schemas import CENTROIDS, GRAPH, INDEX_METADATA, VECTORS
from passagelake.session import reliable
from passagelake.sources.topics import receive

# Layout names and limits of the index.
SHARD_PREFIX = "shard_"
SHARDS_PATH = "shards/"
DISTANCE_METRIC = "l2"
ASSIGNMENT_METHOD = "argmin_distance"
MAX_SHARD_SIZE = 50_000
VERSION_NAME = "v1"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the index, or no rows while it has no files."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def create_empty_index(spark: SparkSession, path: str) -> None:
    """Lay out an index without versions; existing tables are kept."""
    spark.createDataFrame([], INDEX_METADATA).write.mode("ignore").parquet(f"{path}/index_metadata")
    for table, schema in (("centroids", CENTROIDS), ("vectors", VECTORS)):
        empty = spark.createDataFrame([], schema)
        empty.write.mode("ignore").parquet(f"{path}/{table}/index_version=0")


def write_centroids(
    spark: SparkSession, path: str, version: int, centroids: DataFrame | None = None
) -> str:
    """Write the centroids of a version; without any, keep those there or write none."""
    folder = f"{path}/centroids/index_version={version}"
    if centroids is None:
        spark.createDataFrame([], CENTROIDS).write.mode("ignore").parquet(folder)
    else:
        centroids.select("centroid_idx", "centroid").coalesce(1).write.mode("overwrite").parquet(
            folder
        )
    return folder


def write_index_metadata(
    spark: SparkSession,
    path: str,
    version: int,
    num_centroids: int,
    shard_prefix: str = SHARD_PREFIX,
    max_shard_size: int = MAX_SHARD_SIZE,
) -> None:
    """Publish a version by appending its metadata row."""
    spark.range(1).select(
        F.lit(version).cast("bigint").alias("index_version"),
        F.lit(num_centroids).cast("int").alias("num_centroids"),
        F.lit(DISTANCE_METRIC).alias("distance_metric"),
        F.lit(ASSIGNMENT_METHOD).alias("shard_assignment_method"),
        F.lit(shard_prefix).alias("shard_prefix"),
        F.lit(SHARDS_PATH).alias("shards_path"),
        F.lit("centroids").alias("centroids_file"),
        F.lit(max_shard_size).cast("int").alias("max_shard_size"),
        F.current_timestamp().alias("created_at"),
    ).coalesce(1).write.mode("append").parquet(f"{path}/index_metadata")


def write_vectors(
    labelled: DataFrame, path: str, version: int, batch_id: int = 0,
    max_shard_size: int = MAX_SHARD_SIZE,
) -> None:
    """Write one batch of labelled vectors, partitioned by shard.

    The rows arrive clustered by (shard, bin) from the labelling, so writing needs
    no shuffle of its own, and a hot shard is written by as many tasks as it has
    bins. Writing a batch again replaces it. The batch's rows per shard are noted
    beside it, so that nobody has to count all batches again.
    """
    batch = f"index_version={version}/batch_id={batch_id}"
    (
        labelled.sortWithinPartitions("centroid_idx", "label")
        .write.mode("overwrite")
        .partitionBy("centroid_idx")
        .option("maxRecordsPerFile", max_shard_size)
        .parquet(f"{path}/vectors/{batch}")
    )
    written = _read(
        labelled.sparkSession, f"{path}/vectors/{batch}", f"{VECTORS}, centroid_idx int"
    )
    counts = written.groupBy("centroid_idx").agg(F.count(F.lit(1)).alias("num_vectors"))
    counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/shard_counts/{batch}")


def shard_metadata(
    sizes: DataFrame,
    centroids: DataFrame,
    prefix: str = SHARD_PREFIX,
    base_path: str = "",
    version: str = VERSION_NAME,
    max_shard_size: int = MAX_SHARD_SIZE,
) -> DataFrame:
    """One row per shard that has vectors: counts, dimension, centroid, paths.

    ``sizes`` has centroid_idx and num_vectors. Assigned vectors have the dimension
    of their centroid, so the vectors themselves are not read.
    """
    name = shard_name(F.col("centroid_idx"), prefix)

    def path(file):
        return object_path(F.lit(base_path), F.lit("shards"), name, F.lit(file))

    # Both sides have one row per centroid.
    return centroids.join(F.broadcast(sizes), "centroid_idx").select(
        name.alias("shard_id"),
        F.col("centroid_idx").alias("centroid_index"),
        F.col("centroid").alias("centroid_vector"),
        F.size("centroid").alias("embedding_dim"),
        "num_vectors",
        (F.col("num_vectors") > max_shard_size).alias("over_limit"),
        F.struct(
            F.lit(DISTANCE_METRIC).alias("space"), F.lit(max_shard_size).alias("records_per_file")
        ).alias("shard_params"),
        F.struct(path("vectors").alias("vectors"), path("ids").alias("ids"),
                 path("meta").alias("meta")).alias("paths"),
        F.date_format(
            F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()),
            "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'",
        ).alias("created_at"),
        F.lit(version).alias("version"),
    )


def index_summary(metadata: DataFrame) -> DataFrame:
    """One row: status, num_shards and the shards with their paths.

    The list has one entry per shard, so its size is the number of centroids.
    """
    entry = F.struct("shard_id", "num_vectors", "paths")
    return metadata.agg(
        F.when(F.count(F.lit(1)) > 0, "completed").otherwise("empty").alias("status"),
        F.count_distinct("shard_id").alias("num_shards"),
        F.array_sort(F.collect_list(entry)).alias("shards"),
    )


@dataclass
class VectorIndex:
    """A finished version of a stored index."""

    spark: SparkSession
    path: str
    version: int

    def metadata(self):
        """The row that published this version, or None for one that is not published."""
        rows = finished_versions(self.spark, self.path).where(F.col("index_version") == self.version)
        return rows.orderBy(F.desc("created_at")).first()

    def centroids(self) -> DataFrame:
        """The centroids; a version that was published with some must still have them."""
        folder = f"{self.path}/centroids/index_version={self.version}"
        published = self.metadata()
        if published is not None and published["num_centroids"]:
            return self.spark.read.schema(CENTROIDS).parquet(folder)
        return _read(self.spark, folder, CENTROIDS)

    def vectors(self, shards: list[int] | None = None) -> DataFrame:
        """The vectors, or only those of ``shards``; a shard without rows gives none.

        The shard is a partition column: naming shards means reading only their files.
        """
        folder = f"{self.path}/vectors/index_version={self.version}"
        schema = f"{VECTORS}, batch_id bigint, centroid_idx int"
        if self.shard_sizes().isEmpty():
            rows = _read(self.spark, folder, schema)
        else:
            # Counts say that there are vectors: a missing table is an error.
            rows = self.spark.read.schema(schema).parquet(folder)
        return rows if shards is None else rows.where(F.col("centroid_idx").isin(shards))

    def shard_sizes(self, before_batch: int | None = None) -> DataFrame:
        """Vectors per shard, over all batches or those before one."""
        counts = _read(
            self.spark,
            f"{self.path}/shard_counts/index_version={self.version}",
            "num_vectors bigint, centroid_idx int, batch_id bigint",
        )
        if before_batch is not None:
            counts = counts.where(F.col("batch_id") < before_batch)
        return counts.groupBy("centroid_idx").agg(F.sum("num_vectors").alias("num_vectors"))

    def shard_metadata(self) -> DataFrame:
        """The shards as they are now, whether built at once, appended to or filled by a stream."""
        published = self.metadata()
        prefix = published["shard_prefix"] if published else SHARD_PREFIX
        limit = published["max_shard_size"] if published else MAX_SHARD_SIZE
        return shard_metadata(self.shard_sizes(), self.centroids(), prefix, self.path, max_shard_size=limit)

    def search(self, queries: DataFrame, k: int = 3, nprobe: int = 3, **options) -> DataFrame:
        return search_passages(queries, self.vectors(), self.centroids(), k, nprobe=nprobe, **options)

    def build_graph(self, **options) -> None:
        """Store the neighbour lists of this version's shards; building again replaces them."""
        rows = self.vectors().select("chunk_id", "embedding", "label", "centroid_idx")
        linked = build_graph(rows, **options).repartitionByRange("centroid_idx", "label")
        (
            linked.sortWithinPartitions("centroid_idx", "label")
            .write.mode("overwrite")
            .partitionBy("centroid_idx")
            .parquet(f"{self.path}/graph/index_version={self.version}")
        )

    def graph(self) -> DataFrame:
        """The stored graph; it must have been built after the last batch was appended."""
        found = _read(self.spark, f"{self.path}/graph/index_version={self.version}", GRAPH)
        there = self.shard_sizes().agg(F.sum("num_vectors")).first()[0] or 0
        if found.count() != there:
            raise ValueError("the graph does not cover the vectors: build it (again)")
        return found

    def search_graph(self, queries: DataFrame, k: int = 3, nprobe: int = 3, **options) -> DataFrame:
        """Hits of walks through the graph with their texts, looked up by label for the winners alone."""
        hits = reliable(search_graph(queries, self.graph(), self.centroids(), k, nprobe, **options))
        return attach_passages(hits, self.vectors())


    def build_codes(self, **options) -> None:
        """Store this version's vectors as codes; building again replaces them."""
        rows, version = self.vectors().select("chunk_id", "embedding", "label", "centroid_idx"), f"index_version={self.version}"
        books = train_codebooks(rows, **options)
        books.frame(self.spark).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/codebooks/{version}")
        coded = quantise(rows, books).repartitionByRange("centroid_idx", "label").sortWithinPartitions("centroid_idx", "label")
        coded.write.mode("overwrite").partitionBy("centroid_idx").parquet(f"{self.path}/codes/{version}")

    def codes(self) -> DataFrame:
        """The stored codes; they must have been built after the last batch was appended."""
        found = _read(self.spark, f"{self.path}/codes/index_version={self.version}", CODES)
        there = self.shard_sizes().agg(F.sum("num_vectors")).first()[0] or 0
        if found.count() != there:
            raise ValueError("the codes do not cover the vectors: build them (again)")
        return found

    def search_codes(self, queries: DataFrame, k: int = 3, nprobe: int = 3, **options) -> DataFrame:
        """Hits by codes with their texts, looked up by label for the winners alone."""
        books = Codebooks.of(self.spark.read.parquet(f"{self.path}/codebooks/index_version={self.version}"))
        vectors = self.vectors()
        return attach_passages(search_quantised(queries, self.codes(), vectors, self.centroids(), books, k, nprobe, **options), vectors)


def finished_versions(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, f"{path}/index_metadata", INDEX_METADATA)


def open_index(spark: SparkSession, path: str, version: int | None = None) -> VectorIndex:
    """The newest finished version, or the named one."""
    if version is None:
        version = finished_versions(spark, path).agg(F.max("index_version")).first()[0]
        if version is None:
            raise FileNotFoundError(f"no finished index at {path}")
    return VectorIndex(spark, path, version)


def _claim_version(spark: SparkSession, path: str) -> int:
    """A version number that no other build has: its claim is a folder that only one build can create."""
    last = finished_versions(spark, path).agg(F.max("index_version")).first()[0]
    version = (last or 0) + 1
    while True:
        try:
            spark.range(0).write.mode("errorifexists").parquet(f"{path}/claims/index_version={version}")
            return version
        except AnalysisException as taken:
            if taken.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            version += 1


def compact_index(index: VectorIndex) -> VectorIndex:
    """A new version with the same rows and labels, its many appended batches made one.

    Rows are dealt by ranges of shard and label, so a hot shard is written by several
    tasks; readers of the old version are not disturbed.
    """
    spark, path = index.spark, index.path
    published, centroids = index.metadata(), index.centroids()
    version = _claim_version(spark, path)
    write_centroids(spark, path, version, centroids)
    limit = published["max_shard_size"]
    rows = index.vectors().drop("batch_id").repartitionByRange("centroid_idx", "label")
    write_vectors(rows, path, version, max_shard_size=limit)
    write_index_metadata(spark, path, version, published["num_centroids"], published["shard_prefix"], limit)
    return VectorIndex(spark, path, version)


def build_index(
    embedded: DataFrame,
    path: str,
    num_centroids: int = 30,
    max_samples: int | None = None,
    centroids: DataFrame | None = None,
    shard_prefix: str = SHARD_PREFIX,
    max_shard_size: int = MAX_SHARD_SIZE,
) -> DataFrame:
    """Train (unless given) centroids, assign, label and write a new version.

    ``embedded`` has chunk, chunk_id, doc_id, chunk_len and embedding, and should be
    a stored table, since training and labelling read it as well. Returns the
    summary row; status is ``empty`` when there is nothing to index.
    """
    spark = embedded.sparkSession
    if centroids is None:
        centroids = train_centroids(
            embedded, num_centroids=num_centroids, max_samples=max_samples
        )
    found = centroids.count()
    if not found:
        return spark.createDataFrame(
            [("empty", 0)], "status string, num_shards bigint"
        )
    version = _claim_version(spark, path)
    write_centroids(spark, path, version, centroids)
    index = VectorIndex(spark, path, version)
    assigned = assign_nearest(
        embedded.select("chunk", "chunk_id", "doc_id", "chunk_len", "embedding"), index.centroids()
    ).drop("centroid_distance")
    # Counting the table reads no column; counting what was assigned would assign it.
    # They are stored, so that labelling, which counts before it numbers, assigns once.
    labelled = dense_labels(reliable(assigned), total=embedded.count())
    write_vectors(labelled, path, version, max_shard_size=max_shard_size)
    write_index_metadata(spark, path, version, found, shard_prefix, max_shard_size)
    return index_summary(index.shard_metadata())


def build_index_from_topic(
    spark: SparkSession, topic: str, path: str, max_messages: int | None = None, **options
) -> DataFrame:
    """Drain a topic of embedded chunks into a new version of an index.

    At most ``max_messages`` good messages are used, the first by chunk_id; all without it. They are
    validated once and kept as a table, which training and labelling then read.
    """
    good = validate_embedded(receive(spark, topic)).where(F.col("reason").isNull())
    good = good.drop("value", "reason")
    if max_messages is not None:
        good = good.orderBy("chunk_id", "doc_id", "chunk").limit(max(0, max_messages))
    return build_index(reliable(good), path, **options)


def append_vectors(embedded: DataFrame, index: VectorIndex, batch_id: int) -> None:
    """Append a batch to the shards of an index, continuing their labels.

    ``batch_id`` > 0 names the batch: appending it again replaces its rows. Labels
    start after those of the batches before, whatever a failed attempt left behind.
    """
    if batch_id < 1:
        raise ValueError("batch 0 is the build itself")
    earlier = index.shard_sizes(batch_id).withColumnRenamed("num_vectors", "_before")
    assigned = assign_nearest(
        embedded.select("chunk", "chunk_id", "doc_id", "chunk_len", "embedding"), index.centroids()
    ).drop("centroid_distance")
    # One row per centroid.
    continued = (
        dense_labels(reliable(assigned), total=embedded.count())
        .join(F.broadcast(earlier), "centroid_idx", "left")
        .withColumn("label", F.col("label") + F.coalesce("_before", F.lit(0)))
        .drop("_before")
    )
    write_vectors(continued, index.path, index.version, batch_id)
