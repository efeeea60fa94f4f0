"""Routed and exact top-k search over vectors partitioned by centroid."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from passagelake.functions.vectors import nearest, pair_scores, to_matrix, unit_rows
from passagelake.operators.centroids import centroid_matrix, route
from passagelake.session import reliable

# Results and probes per query.
TOP_K = 3
NPROBE = 3

METRICS = ("inner", "cosine", "l2")

# Queries up to this many numbers are sent to every task; more are joined.
BROADCAST_NUMBERS = 16 * 1024 * 1024
BROADCAST_QUERIES = 100_000
BROADCAST_RESULTS = 300_000
# Results up to this many are looked up by literal conditions.
LOOKUP_RESULTS = 200
# Largest score block held at once inside a task.
BLOCK_NUMBERS = 1024 * 1024
# Vectors and queries that meet in one task of the joined form.
PIECE_NUMBERS = 16 * 1024 * 1024
BLOCK_QUERIES = 4096


def trim_copies(vectors: np.ndarray, ids: pd.Series, k: int) -> np.ndarray:
    """Rows that can still be in a top k: of equal vectors, the k smallest ids.

    Copies always score the same and are ranked by id, so leaving the others out
    changes no result. A table may hold a great many copies of one vector.
    """
    rows = np.ones(len(vectors), dtype=bool)
    if len(vectors) <= k:
        return rows
    bits = np.ascontiguousarray(vectors).view(np.uint32)
    code = np.zeros(len(vectors), dtype=np.uint64)
    for column in range(bits.shape[1]):
        code = code * np.uint64(0x9E3779B97F4A7C15) + bits[:, column]
    order = np.argsort(code, kind="stable")
    starts = np.nonzero(np.diff(code[order], prepend=code[order[0]] + np.uint64(1)))[0]
    sizes = np.diff(np.append(starts, len(order)))
    for start, size in zip(starts[sizes > k], sizes[sizes > k]):
        group = order[start : start + size]
        group = group[(vectors[group] == vectors[group[0]]).all(axis=1)]
        by_id = ids.iloc[group].argsort(kind="stable").to_numpy()
        rows[group[by_id[k:]]] = False
    return rows


class TopK:
    """Running best ``k`` hits of each query inside one task, scored block by block."""

    def __init__(self, queries: np.ndarray, k: int, metric: str):
        self.metric = metric
        self.k = k
        self.queries = np.asarray(queries, dtype=np.float64)
        if metric != "l2":
            self.queries = unit_rows(self.queries)
        self.single = self.queries.astype(np.float32)
        self.norms = np.sqrt(np.square(self.queries).sum(axis=1))
        self.floor = np.full(len(queries), -np.inf)
        self.hits: list[pd.DataFrame] = []
        self.held = 0

    def add(self, vectors: np.ndarray, keys: pd.DataFrame, chosen: np.ndarray) -> None:
        """Offer ``vectors`` (with their key columns) to the queries at ``chosen``."""
        vectors = np.asarray(vectors, dtype=np.float32)
        kept = trim_copies(vectors, keys["chunk_id"], self.k)
        if not kept.all():
            vectors, keys = vectors[kept], keys[kept]
        step = max(1, BLOCK_NUMBERS // max(1, len(vectors)))
        for start in range(0, len(chosen), step):
            self._offer(vectors, keys, chosen[start : start + step])
        if self.held > 6 * self.k * len(self.queries) + 10_000:
            self._shrink()

    def _offer(self, vectors, keys, chosen) -> None:
        """Single-precision products choose the rows worth scoring in full."""
        lengths = np.sqrt(np.square(vectors, dtype=np.float64).sum(axis=1))
        rough = (vectors @ self.single[chosen].T).astype(np.float64)
        precision = 4e-7 * vectors.shape[1]
        slack = precision * self.norms[chosen] * lengths.max(initial=0.0)
        if self.metric == "cosine":
            rough /= np.where(lengths > 0, lengths, 1.0)[:, None]
            slack = np.full(len(chosen), precision)
        elif self.metric == "l2":
            squares = np.square(lengths)[:, None] + np.square(self.norms[chosen])[None, :]
            rough = 1.0 - (squares - 2.0 * rough)
            slack = precision * squares.max(axis=0)
        slack = slack + 1e-8
        # What earlier blocks found is usually bar enough; else find this block's own.
        passing = rough >= (self.floor[chosen] - slack)[None, :]
        if np.count_nonzero(passing) > 4 * self.k * len(chosen):
            kth = np.partition(rough, len(vectors) - self.k, axis=0)[-self.k]
            bar = np.maximum(self.floor[chosen], kth - slack)
            passing = rough >= (bar - slack)[None, :]
        row, at = np.nonzero(passing)
        if not len(row):
            return
        step = max(1, BLOCK_NUMBERS // max(1, vectors.shape[1]))
        score = np.concatenate(
            [
                pair_scores(
                    self.queries[chosen[at[i : i + step]]], vectors[row[i : i + step]], self.metric
                )
                for i in range(0, len(row), step)
            ]
        )
        if len(row) > self.k * len(chosen):
            # Copies of one vector tie: cut by score and id before touching the keys.
            by_id = keys["chunk_id"].argsort(kind="stable").to_numpy()
            place = np.empty(len(by_id), dtype=np.int64)
            place[by_id] = np.arange(len(by_id))
            order = np.lexsort((place[row], -score, at))
            row, at, score = row[order], at[order], score[order]
            first = np.searchsorted(at, at, side="left")
            best = np.arange(len(at)) - first < self.k
            row, at, score = row[best], at[best], score[best]
        found = keys.iloc[row].reset_index(drop=True)
        found["_query"] = chosen[at]
        found["score"] = score
        self.hits.append(found)
        self.held += len(found)

    def _shrink(self) -> None:
        """Drop hits below each query's k-th score, and raise the bar to it."""
        held = pd.concat(self.hits, ignore_index=True)
        query, score = held["_query"].to_numpy(), held["score"].to_numpy()
        order = np.lexsort((-score, query))
        query, score = query[order], score[order]
        first = np.searchsorted(query, query, side="left")
        last = np.searchsorted(query, query, side="right")
        full = last - first >= self.k
        kth = np.where(full, score[np.minimum(first + self.k, last) - 1], -np.inf)
        self.floor[query[full]] = kth[full]
        best = held.iloc[order[score >= kth]]
        if len(best) > 2 * self.k * len(self.queries):
            best = self._cut(best)
        self.hits, self.held = [best], len(best)

    def _cut(self, held: pd.DataFrame) -> pd.DataFrame:
        """Exactly the best k per query, equal scores by id."""
        best = held.sort_values(
            ["_query", "score", "chunk_id"], ascending=[True, False, True], kind="stable"
        )
        return best[best.groupby("_query").cumcount() < self.k]

    def result(self) -> pd.DataFrame | None:
        if not self.hits:
            return None
        self._shrink()
        return self._cut(self.hits[0])


def hit_schema(queries: DataFrame, vectors: DataFrame, keys: list[str]) -> T.StructType:
    fields = [T.StructField("query_id", queries.schema["query_id"].dataType)]
    fields += [T.StructField(k, vectors.schema[k].dataType) for k in keys]
    return T.StructType(fields + [T.StructField("score", T.DoubleType())])


def key_columns(vectors: DataFrame) -> list[str]:
    return ["centroid_idx", "chunk_id"] + (["label"] if "label" in vectors.columns else [])


def _broadcast_hits(
    vectors, asked: pa.Table, names, matrix, k, nprobe, metric, per_shard, schema, keys
):
    """Every task scans its own vectors against all queries and keeps its best k.

    Nothing is shuffled but k rows per task and query; only routed shards are read.
    """
    dim = matrix.shape[1]
    texts, fits = to_matrix(asked.column("embedding"), dim)
    ids = np.array(asked.column("query_id").to_pylist(), dtype=object)[fits]
    probes = names[nearest(texts, matrix, nprobe)[0]]
    if per_shard:
        # A query competes separately in each of its shards.
        texts, ids = np.repeat(texts, probes.shape[1], axis=0), np.repeat(ids, probes.shape[1])
        probes = probes.reshape(-1, 1)
    routed = {int(c): np.nonzero((probes == c).any(axis=1))[0] for c in np.unique(probes)}
    return scan_routed(vectors, texts, ids, routed, k, metric, schema, keys)


def scan_routed(
    vectors: DataFrame, texts: np.ndarray, ids: np.ndarray, routed: dict[int, np.ndarray], k: int, metric: str,
    schema: T.StructType, keys: list[str],
) -> DataFrame:
    """Hits of a bounded number of queries, each in the shards it is routed to.

    ``routed`` has the places of a shard's queries in ``texts`` and ``ids``. At most k rows
    per task and query come out.
    """
    dim = texts.shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast((texts, routed, ids))
    arrow_schema = to_arrow_schema(schema)

    def scan(batches):
        queries, where, query_ids = shared.value
        top = TopK(queries, k, metric)
        for batch in batches:
            block, fits = to_matrix(batch.column("embedding"), dim)
            frame = batch.select(keys).to_pandas()[fits].reset_index(drop=True)
            shard = frame["centroid_idx"].to_numpy()
            for centroid in np.unique(shard):
                rows = np.nonzero(shard == centroid)[0]
                top.add(block[rows], frame.iloc[rows], where[int(centroid)])
        best = top.result()
        if best is not None:
            best["query_id"] = query_ids[best["_query"].to_numpy()]
            yield pa.RecordBatch.from_pandas(
                best[arrow_schema.names], schema=arrow_schema, preserve_index=False
            )

    pruned = vectors.where(F.col("centroid_idx").isin(list(routed)))
    return pruned.select(*keys, "embedding").mapInArrow(scan, schema)


def _joined_hits(vectors, queries, centroids, dim, k, nprobe, metric, schema, keys):
    """Vectors and queries meet per shard in bounded pieces: nothing on the driver.

    A shard is cut into pieces of vectors and blocks of queries by hash; every
    piece meets every block once. Hot shards simply have more pieces.
    """
    routed = reliable(
        route(queries, centroids, nprobe).select(
            "query_id", "centroid_idx", F.col("embedding").alias("query_embedding")
        )
    )
    per_piece = max(1000, PIECE_NUMBERS // max(1, dim))

    def parts(rows, per_part, name):
        count = F.ceil(F.count(F.lit(1)) / per_part).cast("int")
        return rows.groupBy("centroid_idx").agg(count.alias(name))

    # One row per centroid, and the number of centroids has been checked.
    cuts = F.broadcast(
        parts(vectors, per_piece, "_pieces").join(
            parts(routed, BLOCK_QUERIES, "_blocks"), "centroid_idx"
        )
    )

    def bucket(columns, count):
        return F.pmod(F.xxhash64(*columns), F.col(count)).cast("int")

    def spread(count):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    by = ["centroid_idx", "_piece", "_block"]
    left = (
        vectors.select(*keys, "embedding")
        .join(cuts, "centroid_idx")
        .withColumn("_piece", bucket([c for c in keys if c != "centroid_idx"], "_pieces"))
        .withColumn("_block", spread("_blocks"))
        .select(*by, *[c for c in keys if c != "centroid_idx"], "embedding")
    )
    right = (
        routed.join(cuts, "centroid_idx")
        .withColumn("_block", bucket(["query_id"], "_blocks"))
        .withColumn("_piece", spread("_pieces"))
        .select(*by, "query_id", "query_embedding")
    )
    arrow_schema = to_arrow_schema(schema)

    def meet(found: pa.Table, wanted: pa.Table) -> pa.Table:
        block, fits = to_matrix(found.column("embedding"), dim)
        texts, asked = to_matrix(wanted.column("query_embedding"), dim)
        if not len(block) or not len(texts):
            return arrow_schema.empty_table()
        top = TopK(texts, k, metric)
        frame = found.select(keys).to_pandas()[fits].reset_index(drop=True)
        top.add(block, frame, np.arange(len(texts)))
        best = top.result()
        ids = np.array(wanted.column("query_id").to_pylist(), dtype=object)[asked]
        best["query_id"] = ids[best["_query"].to_numpy()]
        return pa.Table.from_pandas(
            best[arrow_schema.names], schema=arrow_schema, preserve_index=False
        )

    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, schema)


def score_column(metric: str):
    """A column function of a query's vector and a row's: the score that search gives the pair."""

    @F.arrow_udf("double")
    def score(asked: pa.Array, found: pa.Array) -> pa.Array:
        left, right = to_matrix(asked)[0].astype(np.float64), to_matrix(found)[0]
        return pa.array(pair_scores(left if metric == "l2" else unit_rows(left), right, metric))

    return score


def rank_hits(hits: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """Best ``k`` hits per query (or per query and shard), ranked from 1."""
    ties = ["chunk_id"] + (["label"] if "label" in hits.columns else [])
    best_first = Window.partitionBy(*(by or ["query_id"])).orderBy(F.col("score").desc(), *ties)
    return hits.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)


def query_blocks(queries: DataFrame, most: int) -> Iterator[pa.Table]:
    """The queries (query_id, embedding) in blocks of at most ``most``, by the hash of the id.

    They are stored first, so that whatever embeds them runs once. Ids that repeat beyond
    ``most`` times are parted by their vectors.
    """
    stored = reliable(queries)
    # Blocks of hashes differ a little in size: aim at three quarters, and cut what is larger.
    count = max(1, -(-4 * stored.count() // (3 * most)))
    for number in range(count):
        block = stored.where(F.pmod(F.xxhash64("query_id", "embedding"), F.lit(count)) == number).toArrow()
        for at in range(0, block.num_rows, most):
            yield block.slice(at, most)


def candidate_hits(
    queries: DataFrame,
    vectors: DataFrame,
    centroids: DataFrame,
    k: int = TOP_K,
    nprobe: int = NPROBE,
    metric: str = "inner",
    per_shard: bool = False,
    broadcast_numbers: int = BROADCAST_NUMBERS,
) -> tuple[DataFrame, int | None]:
    """Hits that may enter the top k, and how many queries there are if they are few.

    At most k hits per query (or query and shard) come out of one task's scan, so
    the ranking that follows shuffles little. Whether the queries are few enough
    to broadcast is measured, not assumed. More are sent in blocks that pass by the vectors
    one after the other: vectors are read for each block and never shuffled. Where not even
    one query may be sent, both sides are joined.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    keys = key_columns(vectors)
    schema = hit_schema(queries, vectors, keys)
    names, matrix = centroid_matrix(centroids)
    dim = matrix.shape[1]
    usable = queries.where(F.size("embedding") == dim).select("query_id", "embedding")
    few = min(BROADCAST_QUERIES, broadcast_numbers // (dim * max(1, nprobe)))
    asked = usable.limit(few + 1).toArrow()
    if asked.num_rows == 0:
        return queries.sparkSession.createDataFrame([], schema), 0
    if asked.num_rows <= few:
        hits = _broadcast_hits(
            vectors, asked, names, matrix, k, nprobe, metric, per_shard, schema, keys
        )
        return hits, asked.num_rows
    if few:
        found = [
            reliable(_broadcast_hits(vectors, block, names, matrix, k, nprobe, metric, per_shard, schema, keys))
            for block in query_blocks(usable, few)
        ]
        return reduce(DataFrame.unionByName, found), None
    return _joined_hits(vectors, usable, centroids, dim, k, nprobe, metric, schema, keys), None


def search_vectors(
    queries: DataFrame, vectors: DataFrame, centroids: DataFrame, k: int = TOP_K, **options
) -> DataFrame:
    """Top-k rows per query over its ``nprobe`` nearest shards.

    ``queries`` has query_id and embedding; ``vectors`` has centroid_idx, chunk_id,
    embedding and, from a stored index, label. Returns query_id, the key columns,
    score and rank. ``metric``: "inner" is the dot product with the unit query,
    "cosine" also divides by the vector's length, "l2" is one minus the squared
    distance. Shards are scanned exactly; probing all of them makes the whole
    search exact.
    """
    hits, _ = candidate_hits(queries, vectors, centroids, k, **options)
    return rank_hits(hits, k)


def shard_topk(
    queries: DataFrame, vectors: DataFrame, centroids: DataFrame, k: int = 5, **options
) -> DataFrame:
    """Top-k inside each routed shard; a shard with fewer rows gives all of them."""
    hits, _ = candidate_hits(queries, vectors, centroids, k, per_shard=True, **options)
    return rank_hits(hits, k, ["query_id", "centroid_idx"])


def attach_passages(hits: DataFrame, id_map: DataFrame, few: bool = False) -> DataFrame:
    """Look up text and ids of ranked hits; hits without an entry are dropped.

    Only keys and vectors were scanned to find the hits; text is read here, for
    the rows that won. ``few`` says their number is known to be small.
    """
    keys = [c for c in key_columns(id_map) if c in hits.columns]
    found = id_map.select(*keys, "doc_id", "chunk_len", "chunk")
    return found.join(F.broadcast(hits) if few else hits, keys, "inner")


def _only_pages_with(id_map: DataFrame, hits: DataFrame) -> DataFrame:
    """Narrow an id map to the (shard, label) pairs of a few stored hits.

    Within a file rows are sorted by label, so these literal conditions let the
    parquet reader skip all text pages but those of the winners.
    """
    shards: dict[int, list[int]] = {}
    for row in hits.select("centroid_idx", "label").distinct().collect():
        shards.setdefault(row.centroid_idx, []).append(row.label)
    tests = [
        (F.col("centroid_idx") == shard) & (F.col("label") == label)
        for shard, labels in sorted(shards.items())
        for label in sorted(labels)
    ]
    while len(tests) > 1:
        tests = [
            tests[i] | tests[i + 1] if i + 1 < len(tests) else tests[i]
            for i in range(0, len(tests), 2)
        ]
    return id_map.where(tests[0] if tests else F.lit(False))


def search_passages(
    queries: DataFrame, vectors: DataFrame, centroids: DataFrame, k: int = TOP_K, **options
) -> DataFrame:
    """Result rows: query_id, rank, chunk_id, doc_id, score, text, metadata.

    A handful of queries is searched at once and their texts are looked up by
    label; for more, hits and texts are joined.
    """
    hits, asked = candidate_hits(queries, vectors, centroids, k, **options)
    hits, id_map = rank_hits(hits, k), vectors
    few = asked is not None and asked * k <= BROADCAST_RESULTS
    if few and asked * k <= LOOKUP_RESULTS and "label" in vectors.columns:
        hits = reliable(hits)
        id_map = _only_pages_with(vectors, hits)
    rows = attach_passages(hits, id_map, few)
    label = F.col("label") if "label" in rows.columns else F.lit(None).cast("bigint")
    return rows.select(
        "query_id",
        "rank",
        "chunk_id",
        "doc_id",
        "score",
        F.col("chunk").alias("text"),
        F.struct(
            label.alias("label"),
            "chunk_id",
            "doc_id",
            "chunk_len",
            F.col("chunk").alias("chunk_text"),
        ).alias("metadata"),
    )


def search_responses(queries: DataFrame, results: DataFrame) -> DataFrame:
    """One row per query: ranked results and total_candidates, their number after the cut.

    At most k results are gathered per query.
    """
    item = F.struct("rank", "chunk_id", "doc_id", "score", "text")
    gathered = results.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("results"))
    return (
        queries.select("query_id")
        .join(gathered, "query_id", "left")
        .select(
            "query_id",
            F.coalesce("results", F.array()).alias("results"),
            F.coalesce(F.size("results"), F.lit(0)).alias("total_candidates"),
        )
    )


def recall_at_k(routed: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact top-k that routed search found, averaged over the queries."""
    found = routed.select("query_id", "chunk_id", F.lit(1.0).alias("hit"))
    per_query = (
        exact.select("query_id", "chunk_id")
        .join(found, ["query_id", "chunk_id"], "left")
        .groupBy("query_id")
        .agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))
    )
    return per_query.agg(F.count(F.lit(1)).alias("queries"), F.avg("recall").alias("recall"))
