"""Record layouts shared by the stages, as DDL."""

RAW_DOCUMENT = "id string, text string"

CHUNK = (
    "chunk string, doc_id string, chunk_len int, chunk_id string, "
    "source_file string, created_at timestamp"
)

EMBEDDED = (
    "chunk string, chunk_id string, doc_id string, chunk_len int, embedding array<float>"
)

CENTROIDS = "centroid_idx int, centroid array<double>"

VECTORS = f"{EMBEDDED}, label bigint"

GRAPH = "chunk_id string, embedding array<float>, label bigint, neighbours array<bigint>, centroid_idx int"

INDEX_METADATA = (
    "index_version bigint, num_centroids int, distance_metric string, "
    "shard_assignment_method string, shard_prefix string, shards_path string, "
    "centroids_file string, max_shard_size int, created_at timestamp"
)

DEAD_LETTER = "value string, reason string"
