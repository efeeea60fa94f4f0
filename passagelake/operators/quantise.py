"""Quantised vectors: scanned as short codes, scored in full where it matters.

A vector is cut into parts, and each part is replaced by the nearest entry of a codebook
that k-means gave on a bounded sample: a byte for each part. A query's products with all
entries are tables, and a row's approximate score is a sum of looked-up numbers. The best
rows by this score are then read and scored exactly.

Beside its code a row keeps the distance to what the code stands for, which bounds how
far its score can be off. With ``exact`` every row that the bounds cannot rule out is
scored in full, so that the result is that of a scan of the vectors.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from passagelake.functions.vectors import nearest, to_matrix, unit_rows
from passagelake.operators.centroids import centroid_matrix
from passagelake.operators.sampling import sample_rows
from passagelake.operators.search import (
    BROADCAST_RESULTS,
    METRICS,
    NPROBE,
    TOP_K,
    query_blocks,
    rank_hits,
    score_column,
)
from passagelake.session import reliable

PARTS, ENTRIES = 16, 256
#: Vectors that the codebooks are trained on, at most.
SAMPLE = 50 * ENTRIES
STEPS = 8
#: Rows that are scored in full for each query, if not ``exact``.
CANDIDATES = 100
#: Queries whose tables a task holds at once.
BLOCK_QUERIES = 1024
#: Room for rounding when bounds are compared.
ROOM = 1e-6

CODES = "centroid_idx int, label bigint, code binary, error float, length float"
FOUND = "place bigint, centroid_idx int, label bigint, lower double, upper double, score double"


@dataclass
class Codebooks:
    """``entries[p]``: the (ENTRIES, width) codebook of part p; parts follow each other."""

    entries: list[np.ndarray]

    @property
    def edges(self) -> list[int]:
        return np.concatenate([[0], np.cumsum([e.shape[1] for e in self.entries])]).tolist()

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        edges = self.edges
        columns = [nearest(vectors[:, a:b], e)[0][:, 0] for a, b, e in zip(edges, edges[1:], self.entries)]
        return np.stack(columns, axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([e[codes[:, p]] for p, e in enumerate(self.entries)], axis=1)

    def tables(self, texts: np.ndarray, metric: str) -> list[np.ndarray]:
        """For each part, a query's (row) product with, or squared distance to, each entry (column)."""
        out = []
        for a, b, entries in zip(self.edges, self.edges[1:], self.entries):
            product = texts[:, a:b] @ entries.T
            if metric == "l2":
                product = np.square(texts[:, a:b]).sum(1)[:, None] + np.square(entries).sum(1) - 2 * product
            out.append(product)
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(p, c, e.tolist()) for p, book in enumerate(self.entries) for c, e in enumerate(book)]
        return spark.createDataFrame(rows, "part int, code int, entry array<double>")

    @classmethod
    def of(cls, frame: DataFrame) -> Codebooks:
        books: dict[int, list] = {}
        for row in frame.orderBy("part", "code").collect():
            books.setdefault(row.part, []).append(row.entry)
        return cls([np.array(books[p]) for p in sorted(books)])


def train_codebooks(vectors: DataFrame, parts: int = PARTS, key_col: str = "chunk_id", seed: int = 42) -> Codebooks:
    """Codebooks from a seeded sample of at most SAMPLE vectors; fewer parts if the vectors are short."""
    sample = sample_rows(vectors, key_col, SAMPLE, seed).select("embedding").toArrow()
    matrix = to_matrix(sample.column("embedding"))[0].astype(np.float64)
    if not len(matrix):
        raise ValueError("no vectors to train codebooks on")
    books = []
    for columns in np.array_split(np.arange(matrix.shape[1]), min(parts, max(1, matrix.shape[1]))):
        rows = matrix[:, columns]
        entries = np.unique(rows, axis=0)
        if len(entries) > ENTRIES:
            entries = entries[np.linspace(0, len(entries) - 1, ENTRIES).astype(int)]
            for _ in range(STEPS):
                own = nearest(rows, entries)[0][:, 0]
                count = np.bincount(own, minlength=len(entries))
                sums = np.stack([np.bincount(own, weights=c, minlength=len(entries)) for c in rows.T], axis=1)
                entries = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], entries)
        books.append(entries)
    return Codebooks(books)


def quantise(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """Rows of CODES for vectors with centroid_idx, label and embedding of the codebooks' length; in place."""
    dim = books.edges[-1]
    schema = pa.schema([("centroid_idx", pa.int32()), ("label", pa.int64()), ("code", pa.binary()),
                        ("error", pa.float32()), ("length", pa.float32())])

    def encode(batches):
        for batch in batches:
            block, fits = to_matrix(batch.column("embedding"), dim)
            block = block.astype(np.float64)
            keys = batch.filter(pa.array(fits))
            if not len(block):
                continue
            codes = books.encode(block)
            error = np.sqrt(np.square(block - books.decode(codes)).sum(1)) * (1 + ROOM) + ROOM
            yield pa.RecordBatch.from_arrays(
                [
                    keys.column("centroid_idx").cast(pa.int32()),
                    keys.column("label").cast(pa.int64()),
                    pa.array([c.tobytes() for c in codes], type=pa.binary()),
                    pa.array(error.astype(np.float32)),
                    pa.array(np.sqrt(np.square(block).sum(1)).astype(np.float32)),
                ],
                schema=schema,
            )

    return vectors.select("centroid_idx", "label", "embedding").mapInArrow(encode, CODES)


class _Best:
    """What a task has found for a block of queries: rows that may still matter."""

    def __init__(self, count: int, keep: int, k: int, exact: bool):
        self.keep, self.k, self.exact = keep, k, exact
        self.bar = np.full(count, -np.inf)
        self.rows = [np.empty(0)] * 6
        self.limit = 4 * count * max(keep, k) + 100_000

    def add(self, places, shard, labels, score, lower, upper) -> None:
        """Scores and bounds are (rows, queries)."""
        row, column = np.nonzero((upper if self.exact else score) >= self.bar[places])
        new = [places[column], np.full(len(row), shard), labels[row], lower[row, column], upper[row, column], score[row, column]]
        self.rows = [np.concatenate([a, b]) for a, b in zip(self.rows, new)]
        if len(self.rows[0]) > self.limit:
            self.trim()
            self.limit = max(self.limit, 2 * len(self.rows[0]))

    def trim(self) -> None:
        place, value = self.rows[0], self.rows[3] if self.exact else self.rows[5]
        order = np.lexsort((self.rows[2], self.rows[1], -value, place))
        sorted_place = place[order]
        nth = np.arange(len(order)) - np.searchsorted(sorted_place, sorted_place)
        last = nth == (self.k if self.exact else self.keep) - 1
        self.bar[sorted_place[last].astype(int)] = value[order][last] - ROOM * (1 + np.abs(value[order][last]))
        kept = self.rows[4] >= self.bar[place.astype(int)] if self.exact else order[nth < self.keep]
        self.rows = [column[kept] for column in self.rows]


def _scan(codes: DataFrame, texts, routed, books: Codebooks, k: int, metric: str, keep: int, exact: bool) -> DataFrame:
    """FOUND rows of a block of queries: a task's best by approximate score, or all that may be among the first k."""
    shared = codes.sparkSession.sparkContext.broadcast((texts, routed, books))
    parts = len(books.entries)

    def scan(batches):
        texts, routed, books = shared.value
        tables = books.tables(texts, metric)
        best = _Best(len(texts), keep, k, exact)
        for batch in batches:
            shards = batch.column("centroid_idx").to_numpy()
            labels = batch.column("label").to_numpy()
            found = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            errors, lengths = (batch.column(n).to_numpy().astype(np.float64) for n in ("error", "length"))
            for shard in np.unique(shards).tolist():
                places, rows = routed.get(shard), np.flatnonzero(shards == shard)
                for at in range(0, len(rows), 4096) if places is not None else ():
                    some = rows[at : at + 4096]
                    sums = sum(table[places][:, found[some, p]] for p, table in enumerate(tables)).T
                    error, length = errors[some][:, None], lengths[some][:, None]
                    if metric == "l2":
                        away = np.sqrt(np.maximum(sums, 0.0))
                        score, lower = 1.0 - sums, 1.0 - np.square(away + error)
                        upper = 1.0 - np.square(np.maximum(away - error, 0.0))
                    else:
                        scale = np.maximum(length, 1e-30) if metric == "cosine" else 1.0
                        score, lower, upper = sums / scale, (sums - error) / scale, (sums + error) / scale
                        if metric == "cosine":
                            # A vector without length scores 0.
                            none = np.broadcast_to(length <= 0, sums.shape)
                            score, lower, upper = (np.where(none, 0.0, x) for x in (score, lower, upper))
                    best.add(places, shard, labels[some], score, lower, upper)
        best.trim()
        columns = [c.astype(t) for c, t in zip(best.rows, ("i8", "i4", "i8", "f8", "f8", "f8"))]
        names = [f.split()[0] for f in FOUND.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    pruned = codes.where(F.col("centroid_idx").isin(list(routed)))
    return pruned.select("centroid_idx", "label", "code", "error", "length").mapInArrow(scan, FOUND)


def search_quantised(
    queries: DataFrame,
    codes: DataFrame,
    vectors: DataFrame,
    centroids: DataFrame,
    books: Codebooks,
    k: int = TOP_K,
    nprobe: int = NPROBE,
    metric: str = "inner",
    candidates: int = CANDIDATES,
    exact: bool = False,
) -> DataFrame:
    """Top-k per query over its ``nprobe`` nearest shards, like ``search_vectors``, by codes.

    ``codes`` is what ``quantise`` gives for ``vectors``, as a stored table; vectors are
    read for the candidates alone. Scores are exact. Rows may be missed unless ``exact``,
    fewer with more ``candidates``. Queries pass by in blocks of bounded size; those of
    another dimension or with gaps give no rows.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    spark = queries.sparkSession
    names, matrix = centroid_matrix(centroids)
    kind = queries.schema["query_id"].dataType
    usable = queries.where(F.size("embedding") == matrix.shape[1]).select("query_id", "embedding")
    asked = T.StructType([
        T.StructField("place", T.LongType()), T.StructField("query_id", kind), T.StructField("_asked", T.ArrayType(T.DoubleType())),
    ])
    keys = ["centroid_idx", "label"]
    none = spark.createDataFrame([], asked).select("query_id").crossJoin(vectors.select(*keys, "chunk_id").limit(0))
    hits = [none.select("query_id", *keys, "chunk_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))]
    for block in query_blocks(usable, BLOCK_QUERIES):
        texts, fits = to_matrix(block.column("embedding"), matrix.shape[1])
        ids = [q for q, f in zip(block.column("query_id").to_pylist(), fits.tolist()) if f]
        if not ids:
            continue
        texts = texts.astype(np.float64)
        probes = names[nearest(texts, matrix, nprobe)[0]]
        routed = {int(c): np.flatnonzero((probes == c).any(axis=1)) for c in np.unique(probes)}
        own = texts if metric == "l2" else unit_rows(texts)
        found = reliable(_scan(codes, own, routed, books, k, metric, max(k, candidates), exact))
        best = rank_hits(found.select("place", *keys, F.col("lower" if exact else "score").alias("score"), "upper")
                         .withColumnsRenamed({"place": "query_id", "label": "chunk_id"}), k if exact else max(k, candidates))
        if exact:
            bars = best.where(F.col("rank") == k).select(F.col("query_id").alias("place"), F.col("score").alias("_bar"))
            room = F.lit(ROOM) * (1 + F.abs("_bar"))
            chosen = found.join(bars, "place", "left").where(F.col("_bar").isNull() | (F.col("upper") >= F.col("_bar") - room))
            chosen = chosen.select("place", *keys)
        else:
            chosen = best.select(F.col("query_id").alias("place"), "centroid_idx", F.col("chunk_id").alias("label"))
        chosen = reliable(chosen)
        few = chosen.count() <= BROADCAST_RESULTS
        rows = vectors.where(F.col("centroid_idx").isin(list(routed))).select(*keys, "chunk_id", "embedding")
        rows = rows.join(F.broadcast(chosen) if few else chosen, keys)
        texts_by_place = spark.createDataFrame([(i, q, t) for i, (q, t) in enumerate(zip(ids, texts.tolist()))], asked)
        scored = rows.join(F.broadcast(texts_by_place), "place")
        scored = scored.select("query_id", *keys, "chunk_id", score_column(metric)("_asked", "embedding").alias("score"))
        hits.append(reliable(rank_hits(scored, k)))
    return reduce(DataFrame.unionByName, hits)
