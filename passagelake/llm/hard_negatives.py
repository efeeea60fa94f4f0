"""Hard negatives by threshold joins with suffix-norm bounds.

An anchor's positives are its best rows of the same label; a negative is a row of
another label whose score lies in a window below a positive's score. Both are found
by joins that return every pair whose score reaches a threshold:

* A task indexes its rows in blocks of dimensions, least energy first. A row's first
  dimensions stay out of the index as long as their norm times the anchors' largest
  norm stays below the threshold: they alone can not lift a pair over it. A row that
  is covered whole is not looked at.
* Partial scores are accumulated over the indexed blocks, from the last to the first.
  A pair goes as soon as its partial score and the product of the norms that are left
  of both sides stay below the threshold. What remains is scored to the end, exactly.
* Thresholds start high. Anchors whose windows are not full go again with lower ones,
  down to the window's end, where the result is complete by definition. Inside a task
  a full window lifts its threshold to its own last score.

Anchors are sent to the tasks in groups of bounded size; rows are never shuffled for a
join, and a task gives at most a window's length of rows for each window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from passagelake.session import reliable

#: Anchors sent at once, and the numbers in their vectors.
GROUP = 16_384
GROUP_NUMBERS = 2_000_000
#: Rows, anchors and dimensions of a block of scores.
ROW_BLOCK, ANCHOR_BLOCK, PANEL = 2048, 512, 8
#: Pairs are completed one by one when this share of a block is left.
SPARSE = 0.02
#: Thresholds of positives, as shares of the anchor's product with itself; then all rows.
POSITIVE_SHARES = (0.5, 0.25)
#: Thresholds of negatives, as shares of the way down their window.
NEGATIVE_SHARES = (0.3, 0.6)
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
EXACT = 1 << 53

PAIRS = "win bigint, id bigint, score bigint"


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """Rows (id, label, q) that take part; each component x is floor(scale * x) in q.

    Rows with a null id or label, a null vector, or a null or non-finite component are
    left out. Rows of one id are one: that with the smallest label, then vector.
    """
    vector = F.col(vector_col).cast("array<double>")
    infinite = F.lit(float("inf"))
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < infinite))
    row = F.struct(
        label.cast("bigint").alias("label"), F.transform(vector, lambda x: F.floor(x * F.lit(scale))).alias("q")
    )
    taking_part = rows.where(F.col(id_col).isNotNull() & label.isNotNull() & vector.isNotNull() & finite)
    first = taking_part.select(F.col(id_col).cast("bigint").alias("id"), row.alias("row")).groupBy("id")
    return reliable(first.agg(F.min("row").alias("row")).select("id", "row.label", "row.q"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows of a matrix; missing dimensions are zero."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    sizes = np.minimum(np.diff(offsets), width)
    out = np.zeros((len(column), width), dtype=np.int64)
    at = np.arange(width)[None, :] < sizes[:, None]
    places = (offsets[:-1, None] + np.arange(width)[None, :])[at]
    out[at] = column.values.to_numpy(zero_copy_only=False)[places]
    return out


@dataclass
class Anchors:
    """A group of anchors with their windows, which are numbered anchor by anchor."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    #: Of each window: the anchor, the scores it takes, and how many rows.
    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    number: np.ndarray
    size: int
    same_label: bool


class ThresholdJoin:
    """The best rows of each window, over the rows that a task is given."""

    def __init__(self, anchors: Anchors):
        self.anchors = anchors
        vectors = anchors.vectors.astype(np.float64)
        self.order = np.argsort((vectors**2).sum(0), kind="stable")
        self.q = vectors[:, self.order]
        self.edges = [*range(0, self.q.shape[1], PANEL), self.q.shape[1]]
        self.q_norms = self._prefix_norms(self.q)
        self.low = anchors.low.copy()
        # The windows of an anchor stand next to each other.
        self.first = np.searchsorted(anchors.anchor, np.arange(len(anchors.ids)))
        self.count = np.bincount(anchors.anchor, minlength=len(anchors.ids))
        self.win, self.score, self.id = (np.empty(0, dtype=np.int64) for _ in range(3))

    def _prefix_norms(self, x: np.ndarray) -> np.ndarray:
        """Norms of the dimensions before each edge, a little too large rather than too small."""
        sums = np.concatenate([np.zeros((len(x), 1)), np.cumsum(x**2, axis=1)], axis=1)
        return np.sqrt(sums[:, self.edges]) * (1 + 1e-9)

    def _thresholds(self) -> np.ndarray:
        """The lowest score that any window of an anchor still takes."""
        out = np.full(len(self.first), np.inf)
        np.minimum.at(out, self.anchors.anchor, self.low.astype(np.float64))
        return out

    def add(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        largest = int(np.abs(vectors).max(initial=0)) * int(np.abs(self.anchors.vectors).max(initial=0))
        for at in range(0, len(ids), ROW_BLOCK):
            part = slice(at, at + ROW_BLOCK)
            if largest * max(1, vectors.shape[1]) >= EXACT:
                self._add_large(ids[part], labels[part], vectors[part])
                continue
            x = vectors[part][:, self.order].astype(np.float64)
            norms = self._prefix_norms(x)
            t = self._thresholds()
            # Blocks of anchors with similar thresholds, in the anchors' own lengths.
            relative = np.where(np.isfinite(t), t, HIGHEST) / np.maximum(self.q_norms[:, -1], 1e-300)
            ranked = np.argsort(relative, kind="stable")
            ranked = ranked[np.isfinite(t[ranked])]
            for start in range(0, len(ranked), ANCHOR_BLOCK):
                block = ranked[start : start + ANCHOR_BLOCK]
                rows, columns, scores = self._pairs(x, norms, block, t[block], relative[block[0]])
                self._keep(ids[part][rows], labels[part][rows], block[columns], scores)

    def _pairs(self, x, norms, block, t, lowest):
        """All pairs of rows and anchors of a block that reach the anchors' thresholds."""
        q, q_norms, last = self.q[block], self.q_norms[block], len(self.edges) - 1
        # The blocks of dimensions that stay out of the index, for each row.
        out = np.maximum((norms < lowest).sum(1) - 1, 0)
        alive = np.flatnonzero(out < last)
        partial = np.zeros((len(alive), len(block)))
        left = partial > 0
        for panel in range(last - 1, -1, -1):
            a, b = self.edges[panel], self.edges[panel + 1]
            indexed = out[alive] <= panel
            partial[indexed] += x[alive[indexed], a:b] @ q[:, a:b].T
            rest = np.maximum(out[alive], panel)
            left = partial + norms[alive, rest][:, None] * q_norms[:, rest].T + 1e-6 >= t
            some = left.any(1)
            alive, partial, left = alive[some], partial[some], left[some]
            if left.sum() <= SPARSE * left.size:
                break
        rows, columns = np.nonzero(left)
        scores, rows = partial[rows, columns], alive[rows]
        rest = np.maximum(out[rows], panel)
        for panel in range(int(rest.max(initial=0)) - 1, -1, -1):
            a, b = self.edges[panel], self.edges[panel + 1]
            more = rest > panel
            scores[more] += np.einsum("ij,ij->i", x[rows[more], a:b], q[columns[more], a:b])
            rest = np.minimum(rest, panel)
            held = scores + norms[rows, rest] * q_norms[columns, rest] + 1e-6 >= t[columns]
            rows, columns, scores, rest = rows[held], columns[held], scores[held], rest[held]
        held = scores >= t[columns]
        return rows[held], columns[held], scores[held].astype(np.int64)

    def _add_large(self, ids, labels, vectors) -> None:
        """Scores beyond what doubles hold exactly: whole products of Python's integers."""
        q = self.anchors.vectors.astype(object)
        for start in range(0, len(ids), 64):
            part = slice(start, start + 64)
            scores = np.clip(vectors[part].astype(object) @ q.T, LOWEST, HIGHEST).astype(np.int64)
            rows, columns = np.indices(scores.shape)
            self._keep(ids[part][rows.ravel()], labels[part][rows.ravel()], columns.ravel(), scores.ravel())

    def _keep(self, ids, labels, columns, scores) -> None:
        anchors = self.anchors
        same = labels == anchors.labels[columns]
        fits = (same & (ids != anchors.ids[columns])) if anchors.same_label else ~same
        ids, columns, scores = ids[fits], columns[fits], scores[fits]
        for nth in range(int(self.count.max(initial=0))):
            has = nth < self.count[columns]
            win = self.first[columns[has]] + nth
            inside = (scores[has] >= self.low[win]) & (scores[has] <= anchors.high[win])
            self.win = np.concatenate([self.win, win[inside]])
            self.score = np.concatenate([self.score, scores[has][inside]])
            self.id = np.concatenate([self.id, ids[has][inside]])
            if len(self.win) > 2 * len(self.low) * anchors.size + 100_000:
                self._trim()
        self._trim()

    def _trim(self) -> None:
        """Keep a window's first rows; a full window takes nothing below its last score."""
        order = np.lexsort((self.id, -self.score, self.win))
        win = self.win[order]
        place = np.arange(len(win)) - np.searchsorted(win, win)
        order, place = order[place < self.anchors.size], place[place < self.anchors.size]
        self.win, self.score, self.id = self.win[order], self.score[order], self.id[order]
        full = place == self.anchors.size - 1
        self.low[self.win[full]] = np.maximum(self.low[self.win[full]], self.score[full])


def _joined(rows: DataFrame, anchors: Anchors, complete: bool) -> DataFrame:
    """Ranked rows of each window: of the full ones, or if ``complete`` of all."""
    sent = rows.sparkSession.sparkContext.broadcast(anchors)

    def join(batches):
        index = ThresholdJoin(sent.value)
        width = index.anchors.vectors.shape[1]
        for batch in batches:
            for at in range(0, batch.num_rows, 8 * ROW_BLOCK):
                part = batch.slice(at, 8 * ROW_BLOCK)
                vectors = pa.concat_arrays([part.column("q")])
                index.add(
                    part.column("id").to_numpy(), part.column("label").to_numpy(), _matrix(vectors, width)
                )
        columns = [pa.array(index.anchors.number[index.win]), pa.array(index.id), pa.array(index.score)]
        yield pa.RecordBatch.from_arrays(columns, names=["win", "id", "score"])

    window = Window.partitionBy("win")
    ranked = rows.mapInArrow(join, PAIRS).withColumn(
        "rank", F.row_number().over(window.orderBy(F.col("score").desc(), "id"))
    )
    best = ranked.where(F.col("rank") <= anchors.size).withColumn("held", F.max("rank").over(window))
    return reliable(best if complete else best.where(F.col("held") == anchors.size)).drop("held")


def _filled(rows: DataFrame, ids, labels, vectors, windows, size: int, same_label: bool, thresholds) -> DataFrame:
    """Rounds of joins with falling thresholds until every window is full or complete.

    ``windows`` has (number, anchor, lowest, highest score); ``thresholds`` gives the
    threshold of a window in each round but the last.
    """
    found = rows.sparkSession.createDataFrame([], PAIRS + ", rank int")
    for level in range(thresholds.levels + 1):
        complete = level == thresholds.levels
        if not windows:
            break
        low = [w[2] if complete else min(HIGHEST, max(w[2], thresholds(level, w))) for w in windows]
        used = sorted({w[1] for w in windows})
        place = {a: i for i, a in enumerate(used)}
        anchors = Anchors(
            ids[used],
            labels[used],
            vectors[used],
            np.array([place[w[1]] for w in windows]),
            np.array(low, dtype=np.int64),
            np.array([w[3] for w in windows], dtype=np.int64),
            np.array([w[0] for w in windows], dtype=np.int64),
            size,
            same_label,
        )
        best = _joined(rows, anchors, complete)
        found = found.unionByName(best)
        if not complete:
            full = {r.win for r in best.where(F.col("rank") == size).select("win").collect()}
            windows = [w for w in windows if w[0] not in full]
    return found


class _Shares:
    """Thresholds as shares of a window: from its top (negatives) or of the anchor's own product."""

    def __init__(self, shares, own=None):
        self.shares, self.levels, self.own = shares, len(shares), own

    def __call__(self, level: int, window) -> int:
        number, anchor, low, high = window
        if self.own is not None:
            return int(self.shares[level] * self.own[anchor])
        return high - int((high - low) * self.shares[level])


def mine(
    rows: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | None = None,
    positives: int = 5,
    negatives: int = 10,
    window: tuple[int, int, int] = (30, 90, 100),
    scale: int = 256,
) -> DataFrame:
    """Negatives of each anchor and positive: anchor_id, positive_id, rank, negative_id and both scores.

    Scores are integer inner products of the vectors' floor(scale * x). An anchor's positives
    are its first other rows of the same label. With ``window`` (low, high, whole) a negative
    is a row of another label with low * positive <= whole * negative <= high * positive;
    the first ``negatives`` of them are returned, higher scores first, then smaller ids.

    ``is_anchor`` is a condition on the column ``id``, that of the rows' ids. Rows with nulls
    or non-finite numbers take no part; rows that repeat an id count once (see
    ``whole_vectors``); a shorter vector has zeros behind; products beyond 64 bits stop at the
    largest; an empty table, an anchor without positives, and a positive whose window is
    empty give no rows. Other columns are not looked at.
    """
    spark = rows.sparkSession
    whole = whole_vectors(rows, id_col, vector_col, F.col("label") if label is None else label, scale)
    chosen = whole.where(is_anchor)
    counted = chosen.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("q")).alias("width")).first()
    width = max(1, counted.width or 0)
    size = max(1, min(GROUP, GROUP_NUMBERS // width))
    groups = -(-counted.n // size)
    low, high, parts = window
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint"
    result = spark.createDataFrame([], schema + ", positive_score bigint, negative_score bigint")
    for group in range(groups):
        # Ids differ, so the groups of their hashes are of nearly one size.
        member = F.pmod(F.xxhash64("id"), F.lit(groups)) == group
        held = chosen.where(member).toArrow().combine_chunks()
        if not held.num_rows:
            continue
        ids, labels = held["id"].to_numpy(), held["label"].to_numpy()
        vectors = _matrix(pa.concat_arrays(held["q"].chunks), width)
        own = [sum(x * x for x in v) for v in vectors.astype(object)]
        starts = [(i, i, LOWEST, HIGHEST) for i in range(len(ids))]
        same = _filled(rows=whole, ids=ids, labels=labels, vectors=vectors, windows=starts, size=positives,
                       same_label=True, thresholds=_Shares(POSITIVE_SHARES, own))
        first = [(r.win, r.rank, r.id, r.score) for r in same.collect()]
        windows = []
        for anchor, rank, _, score in sorted(first):
            bounds = -(-low * score // parts), high * score // parts
            if bounds[0] <= bounds[1]:
                windows.append((anchor * positives + rank - 1, anchor, *bounds))
        other = _filled(rows=whole, ids=ids, labels=labels, vectors=vectors, windows=windows, size=negatives,
                        same_label=False, thresholds=_Shares(NEGATIVE_SHARES))
        named = spark.createDataFrame(
            [(a * positives + r - 1, int(ids[a]), i, s) for a, r, i, s in first],
            "win bigint, anchor_id bigint, positive_id bigint, positive_score bigint",
        )
        result = result.unionByName(
            other.join(F.broadcast(named), "win").select(
                "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                F.col("score").alias("negative_score"),
            )
        )
    return result
