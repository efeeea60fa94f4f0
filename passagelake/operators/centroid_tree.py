"""Centroids by the hundred thousand: a tree of two levels, searched exactly or by a beam.

A flat set of centroids goes to every task as one matrix, which ends at ``MAX_CENTROIDS``.
Here only the branches do. The leaves, which are the centroids, stay in a table; a vector
is sent to the branches it has to open and meets their leaves there. A branch knows its
radius, the distance to its furthest leaf; so the distance to a branch bounds that to
each of its leaves, and what is left unopened in exact mode cannot be nearer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from passagelake.functions.vectors import l2_distance, nearest, to_matrix
from passagelake.operators.centroids import SEED, assign_nearest, centroid_matrix, train_centroids
from passagelake.session import reliable

#: Rows a leaf is trained on, on average, and the most leaves that one task trains together.
ROWS_PER_LEAF = 32
LEAVES_PER_BRANCH = 1024
LLOYD_STEPS = 5
#: Vectors that meet a branch's leaves in one task; more are dealt to several.
ROWS_PER_GROUP = 8192
#: Distances and bounds are compared with this much room for rounding.
ROOM = 1e-9


@dataclass(frozen=True)
class CentroidTree:
    """``branches``: branch, centroid, radius, leaves. ``leaves``: branch, centroid_idx, centroid."""

    branches: DataFrame
    leaves: DataFrame


def build_tree(centroids: DataFrame, branches: int | None = None, seed: int = SEED) -> CentroidTree:
    """A tree over any number of centroids (centroid_idx, centroid); their indices stay.

    There are as many branches as leaves in each by default, the square root of their number.
    Centroids that are null, of another dimension or not finite are an error, as they are for the flat search.
    No centroids, an error too.
    """
    centroids = reliable(
        centroids.select(F.col("centroid_idx").cast("int"), F.col("centroid").cast("array<double>"))
    )
    count = centroids.count()
    if not count:
        raise ValueError("no centroid vectors")
    if branches is None:
        branches = int(np.ceil(np.sqrt(count)))
    top = reliable(train_centroids(centroids, "centroid_idx", "centroid", min(branches, count), seed=seed))
    placed = assign_nearest(
        centroids.withColumnRenamed("centroid_idx", "leaf"), top, "centroid"
    ).select(F.col("centroid_idx").alias("branch"), F.col("leaf").alias("centroid_idx"), "centroid")
    leaves = reliable(placed)
    if leaves.count() != count:
        raise ValueError("centroids differ in dimension or have missing numbers")
    middle = top.select(F.col("centroid_idx").alias("branch"), F.col("centroid").alias("_middle"))
    # One row per branch, and their number has been checked by the assignment.
    gaps = leaves.join(F.broadcast(middle), "branch").select(
        "branch", l2_distance(F.col("centroid"), F.col("_middle")).alias("_gap")
    )
    sizes = gaps.groupBy("branch").agg(F.max("_gap").alias("radius"), F.count(F.lit(1)).alias("leaves"))
    # Branches without a leaf are left out.
    described = sizes.join(F.broadcast(middle), "branch")
    return CentroidTree(
        reliable(described.select("branch", F.col("_middle").alias("centroid"), "radius", "leaves")), leaves
    )


def _below(key: Column, share: Column, seed: int) -> Column:
    """Whether a key's hash falls into a share (0 to 1) of all hashes."""
    steps = 1 << 40
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(steps)) < share * F.lit(float(steps))


def train_leaves(
    vectors: DataFrame,
    num_centroids: int,
    key_col: str = "chunk_id",
    vector_col: str = "embedding",
    branches: int | None = None,
    steps: int = LLOYD_STEPS,
    seed: int = SEED,
) -> DataFrame:
    """About ``num_centroids`` centroids (centroid_idx, centroid) by k-means of k-means.

    A sample by hash, ``ROWS_PER_LEAF`` rows for each centroid, is dealt to trained branches; each branch
    gets leaves in proportion to its rows, ``LEAVES_PER_BRANCH`` at most, trained in one task on a
    sample of bounded size. Copies of one vector make one leaf, so there may be fewer than asked for.
    Null vectors and keys take no part.
    """
    if branches is None:
        branches = max(int(np.ceil(np.sqrt(num_centroids))), -(-2 * num_centroids // LEAVES_PER_BRANCH))
    usable = vectors.where(F.col(vector_col).isNotNull() & F.col(key_col).isNotNull()).select(
        F.col(key_col).alias("key"), F.col(vector_col).alias("vector")
    )
    total = usable.count()
    top = reliable(train_centroids(usable, "key", "vector", branches, seed=seed))
    if top.isEmpty():
        return top
    share = min(1.0, 2.0 * ROWS_PER_LEAF * num_centroids / total)
    sample = reliable(assign_nearest(usable.where(_below(F.col("key"), F.lit(share), seed)), top, "vector"))
    rows = F.sum("n").over(Window.partitionBy())
    wanted = F.greatest(F.lit(1), F.least(F.lit(LEAVES_PER_BRANCH), F.round(F.col("n") * num_centroids / rows)))
    # One row per branch.
    plan = sample.groupBy("centroid_idx").agg(F.count(F.lit(1)).alias("n")).withColumn("wanted", wanted.cast("int"))
    thinned = sample.join(F.broadcast(plan), "centroid_idx").where(
        _below(F.col("key"), F.lit(2.0 * ROWS_PER_LEAF) * F.col("wanted") / F.col("n"), seed + 1)
        | (F.col("n") <= ROWS_PER_LEAF)
    )

    def train(group: pa.Table) -> pa.Table:
        # The order of rows in a group is that of the shuffle: sorted, so that a run can be repeated.
        matrix, _ = to_matrix(group.column("vector"))
        matrix = matrix.astype(np.float64)
        matrix = matrix[np.lexsort(matrix.T[::-1])]
        different = np.unique(matrix, axis=0)
        count = min(group.column("wanted")[0].as_py(), len(different))
        draw = np.random.default_rng(seed).permutation(len(different))[:count]
        centres = different[np.sort(draw)]
        for _ in range(steps if count < len(different) else 0):
            owner = nearest(matrix, centres)[0][:, 0]
            sums = np.zeros_like(centres)
            np.add.at(sums, owner, matrix)
            held = np.bincount(owner, minlength=count)
            centres = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centres)
        branch = group.column("centroid_idx")[0].as_py()
        return pa.table(
            {
                "branch": pa.array([branch] * count, pa.int32()),
                "child": pa.array(range(count), pa.int32()),
                "centroid": pa.array(list(centres), pa.list_(pa.float64())),
            }
        )

    trained = reliable(
        thinned.select("centroid_idx", "wanted", "vector")
        .groupBy("centroid_idx")
        .applyInArrow(train, "branch int, child int, centroid array<double>")
    )
    # Numbered through by the branches' counts: one row per branch.
    before = Window.orderBy("branch").rowsBetween(Window.unboundedPreceding, -1)
    bases = trained.groupBy("branch").agg(F.count(F.lit(1)).alias("n")).select(
        "branch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    return reliable(
        trained.join(F.broadcast(bases), "branch").select(
            (F.col("base") + F.col("child")).cast("int").alias("centroid_idx"), "centroid"
        )
    )


def _branches_to_open(spark, tree: CentroidTree):
    """The branches on the driver and in the tasks: numbers, matrix, radii, leaves."""
    numbers, matrix = centroid_matrix(tree.branches.withColumnRenamed("branch", "centroid_idx"))
    facts = {r.branch: (r.radius, r.leaves) for r in tree.branches.select("branch", "radius", "leaves").collect()}
    radii = np.array([facts[int(b)][0] for b in numbers])
    leaves = np.array([facts[int(b)][1] for b in numbers])
    return spark.sparkContext.broadcast((numbers, matrix, radii, leaves))


def _lists(picked: list[np.ndarray], fits: np.ndarray) -> pa.Array:
    sizes = np.zeros(len(fits), dtype=np.int64)
    sizes[fits] = [len(p) for p in picked]
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    flat = np.concatenate(picked).astype(np.int32) if picked else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _meet_leaves(opened: DataFrame, tree: CentroidTree, count: int) -> DataFrame:
    """(_row, centroid_idx, centroid_distance): the ``count`` nearest leaves of each opened branch.

    ``opened`` is (_row, _vector, branch). A branch that many open is dealt to several groups, which
    its leaves are sent to; so no group grows with the data.
    """
    crowds = opened.groupBy("branch").agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_GROUP).cast("int").alias("_parts"))
    crowds = reliable(crowds)
    # One row per branch.
    dealt = opened.join(F.broadcast(crowds), "branch").withColumn(
        "_part", F.pmod(F.xxhash64("_row"), F.col("_parts")).cast("int")
    ).drop("_parts")
    sent = tree.leaves.join(F.broadcast(crowds), "branch").select(
        "branch", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), "centroid_idx", "centroid"
    )
    out = pa.schema([("_row", pa.int64()), ("centroid_idx", pa.int32()), ("centroid_distance", pa.float64())])

    def score(rows: pa.Table, leaves: pa.Table) -> pa.Table:
        if not rows.num_rows or not leaves.num_rows:
            return out.empty_table()
        names = leaves.column("centroid_idx").to_numpy()
        order = np.argsort(names, kind="stable")
        centres = to_matrix(leaves.column("centroid"))[0][order]
        vectors, _ = to_matrix(rows.column("_vector"), centres.shape[1])
        best, gaps = nearest(vectors, centres, count)
        owner = np.repeat(rows.column("_row").to_numpy(), best.shape[1])
        return pa.table([owner, names[order][best].reshape(-1), gaps.reshape(-1)], schema=out)

    schema = T.StructType(
        [
            T.StructField("_row", T.LongType()),
            T.StructField("centroid_idx", T.IntegerType()),
            T.StructField("centroid_distance", T.DoubleType()),
        ]
    )
    keys = ["branch", "_part"]
    return dealt.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(score, schema)


def _best(found: DataFrame, count: int) -> DataFrame:
    """The ``count`` nearest of each row, numbered; equal distances by index."""
    if count == 1:
        first = found.groupBy("_row").agg(F.min(F.struct("centroid_distance", "centroid_idx")).alias("_b"))
        return first.select("_row", F.lit(1).alias("probe"), "_b.centroid_idx", "_b.centroid_distance")
    order = Window.partitionBy("_row").orderBy("centroid_distance", "centroid_idx")
    return found.withColumn("probe", F.row_number().over(order)).where(F.col("probe") <= count).select(
        "_row", "probe", "centroid_idx", "centroid_distance"
    )


def route_tree(
    queries: DataFrame,
    tree: CentroidTree,
    nprobe: int = 3,
    beam: int | None = None,
    vector_col: str = "embedding",
) -> DataFrame:
    """One row per query and routed centroid, as ``route`` gives: probe, centroid_idx, centroid_distance.

    Without ``beam`` the result is that of the flat search: a query opens its nearest branches until they
    hold ``nprobe`` leaves, and then every branch that its bound does not rule out. With it, the
    ``beam`` nearest branches are opened and no more (fewer rows come back if these hold too few).
    Rows whose vector does not fit the centroids are left out, as by ``route``.
    """
    if nprobe < 1 or (beam is not None and beam < 1):
        raise ValueError("nprobe and beam are 1 or more")
    # Stored with a number of its own for each row: keys may repeat, and the parts are joined again.
    spark = queries.sparkSession
    kept = reliable(queries.withColumn("_row", F.monotonically_increasing_id()))
    rows = kept.where(F.col(vector_col).isNotNull()).select("_row", F.col(vector_col).alias("_vector"))
    shared = _branches_to_open(spark, tree)

    def near(block: np.ndarray) -> list[np.ndarray]:
        numbers, matrix, _, leaves = shared.value
        width = len(numbers) if beam is None else min(beam, len(numbers))
        # As many branches as could be needed to see nprobe leaves.
        width = min(width, nprobe) if beam is None else width
        order = nearest(block, matrix, width)[0]
        if beam is not None:
            return list(numbers[order])
        enough = (np.cumsum(leaves[order], axis=1) >= nprobe).argmax(axis=1)
        full = leaves[order].sum(axis=1) >= nprobe
        return [numbers[o[: (e + 1 if f else len(o))]] for o, e, f in zip(order, enough, full)]

    @F.arrow_udf("array<int>")
    def first_branches(column: pa.Array) -> pa.Array:
        block, fits = to_matrix(column, shared.value[1].shape[1])
        return _lists(near(block) if len(block) else [], fits)

    @F.arrow_udf("array<int>")
    def other_branches(column: pa.Array, reach: pa.Array) -> pa.Array:
        numbers, matrix, radii, _ = shared.value
        block, fits = to_matrix(column, matrix.shape[1])
        if not len(block):
            return _lists([], fits)
        reach = reach.to_numpy(zero_copy_only=False)[fits]
        picked = []
        for vector, limit, done in zip(np.asarray(block, dtype=np.float64), reach, near(block)):
            gaps = np.sqrt(np.square(matrix - vector).sum(axis=1))
            open_ = gaps - radii <= limit + ROOM * (1 + gaps + radii)
            picked.append(np.setdiff1d(numbers[open_], done))
        return _lists(picked, fits)

    first = rows.select("_row", "_vector", F.explode(first_branches.asNondeterministic()("_vector")).alias("branch"))
    if beam is not None:
        best = _best(_meet_leaves(reliable(first), tree, nprobe), nprobe)
    else:
        found = reliable(_meet_leaves(reliable(first), tree, nprobe))
        reach = found.groupBy("_row").agg(
            F.when(F.count(F.lit(1)) >= nprobe, F.get(F.sort_array(F.collect_list("centroid_distance")), F.lit(nprobe - 1)))
            .otherwise(float("inf"))
            .alias("_reach")
        )
        second = rows.join(reach, "_row").select(
            "_row", "_vector", F.explode(other_branches.asNondeterministic()("_vector", "_reach")).alias("branch")
        )
        best = _best(found.unionByName(_meet_leaves(reliable(second), tree, nprobe)), nprobe)
    return kept.join(best, "_row").select(*queries.columns, "probe", "centroid_idx", "centroid_distance")


def assign_tree(
    vectors: DataFrame, tree: CentroidTree, beam: int | None = None, vector_col: str = "embedding"
) -> DataFrame:
    """``assign_nearest`` through a tree: each vector's nearest centroid, exactly unless a beam is given."""
    return route_tree(vectors, tree, 1, beam, vector_col).drop("probe")
