"""Vector arithmetic for Arrow batches, and the column functions built on it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

# A centroid or query matrix above this many numbers is not broadcast.
MAX_BROADCAST_NUMBERS = 64 * 1024 * 1024
# Largest score block held at once inside a task.
BLOCK_NUMBERS = 4 * 1024 * 1024


def to_matrix(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Stack a list column into (rows, dim) floats; also return which rows fit.

    Null vectors, other lengths and vectors with missing or infinite numbers do not fit.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    if dim is None:
        dim = int(lengths.max()) if len(lengths) else 0
    fits = np.array(lengths == dim)
    kept = column if fits.all() else column.filter(pa.array(fits))
    values = kept.flatten().to_numpy(zero_copy_only=False).reshape(int(fits.sum()), dim)
    broken = ~np.isfinite(values).all(axis=1)
    if broken.any():
        fits[np.nonzero(fits)[0][broken]] = False
        values = values[~broken]
    return values, fits


def nearest(
    vectors: np.ndarray, centroids: np.ndarray, count: int = 1
) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` nearest centroids of every vector by L2, and the distances.

    One matrix product narrows the choice; what survives is measured again as a
    plain difference, so equal distances are equal and the lowest index wins.
    """
    centroids = np.asarray(centroids, dtype=np.float64)
    count = min(count, len(centroids))
    rows = len(vectors)
    indices = np.empty((rows, count), dtype=np.int32)
    distances = np.empty((rows, count), dtype=np.float64)
    centroid_norms = np.einsum("ij,ij->i", centroids, centroids)
    step = max(1, BLOCK_NUMBERS // max(1, len(centroids)))
    for start in range(0, rows, step):
        block = np.asarray(vectors[start : start + step], dtype=np.float64)
        norms = np.einsum("ij,ij->i", block, block)
        squared = norms[:, None] - 2.0 * (block @ centroids.T) + centroid_norms[None, :]
        cutoff = np.partition(squared, count - 1, axis=1)[:, count - 1]
        slack = 1e-9 * (norms + centroid_norms.max()) + 1e-300
        row, idx = np.nonzero(squared <= (cutoff + slack)[:, None])
        exact = np.square(block[row] - centroids[idx]).sum(axis=1)
        order = np.lexsort((idx, exact, row))
        row, idx, exact = row[order], idx[order], exact[order]
        first = np.searchsorted(row, np.arange(len(block)))
        pick = first[:, None] + np.arange(count)[None, :]
        indices[start : start + step] = idx[pick]
        distances[start : start + step] = np.sqrt(exact[pick])
    return indices, distances


# Scores are compared at this many decimals, so that the order of a sum never
# decides a rank; equal scores are ranked by id.
SCORE_DECIMALS = 9


def pair_scores(left: np.ndarray, right: np.ndarray, metric: str) -> np.ndarray:
    """Score of each pair of rows."""
    return np.round(_raw_scores(left, right, metric), SCORE_DECIMALS)


def _raw_scores(left, right, metric):
    left = np.asarray(left, dtype=np.float64)
    right = np.asarray(right, dtype=np.float64)
    if metric == "l2":
        return 1.0 - np.square(left - right).sum(axis=1)
    dots = (left * right).sum(axis=1)
    if metric == "cosine":
        norms = np.sqrt(np.square(right).sum(axis=1))
        return np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)
    return dots


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    matrix = np.asarray(matrix, dtype=np.float64)
    norms = np.sqrt(np.square(matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def list_column(matrix: np.ndarray) -> pa.ListArray:
    matrix = np.ascontiguousarray(matrix, dtype=np.float32)
    rows, dim = matrix.shape
    offsets = pa.array(np.arange(0, (rows + 1) * dim, dim, dtype=np.int32)[: rows + 1])
    if dim == 0:
        offsets = pa.array(np.zeros(rows + 1, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.reshape(-1)))


def _pairwise(score):
    """A column function of two vector columns, evaluated on Arrow batches."""

    @F.arrow_udf("double")
    def evaluate(a: pa.Array, b: pa.Array) -> pa.Array:
        out = np.full(len(a), np.nan)
        empty = np.ones(len(a), dtype=bool)
        same = a.value_lengths().equals(b.value_lengths()) and a.null_count == 0
        if same and len(set(a.value_lengths().to_pylist())) == 1:
            groups = [np.arange(len(a))]
        else:
            sizes = a.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            other = b.value_lengths().fill_null(-2).to_numpy(zero_copy_only=False)
            groups = [
                np.nonzero((sizes == n) & (other == n))[0] for n in np.unique(sizes)
            ]
        for rows in groups:
            if not len(rows):
                continue
            take = pa.array(rows)
            left, _ = to_matrix(a.take(take))
            right, _ = to_matrix(b.take(take))
            out[rows] = score(
                left.astype(np.float64, copy=False), right.astype(np.float64, copy=False)
            )
            empty[rows] = False
        return pa.array(out, mask=empty)

    return evaluate


def l2_distance(a: Column, b: Column) -> Column:
    return _pairwise(lambda x, y: np.sqrt(np.square(x - y).sum(axis=1)))(a, b)


def inner_product(a: Column, b: Column) -> Column:
    return _pairwise(lambda x, y: (x * y).sum(axis=1))(a, b)


def cosine(a: Column, b: Column) -> Column:
    def score(x, y):
        norms = np.sqrt(np.square(x).sum(axis=1) * np.square(y).sum(axis=1))
        dots = (x * y).sum(axis=1)
        return np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)

    return _pairwise(score)(a, b)
