import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagelake.llm import hard_negatives
from passagelake.llm.hard_negatives import mine

SCHEMA = "vec_id bigint, embedding array<float>, label int, _text string, rank int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def expected(rows, anchors=100, positives=5, negatives=10):
    """By all pairs, in Python's integers."""
    whole = {}
    for at, vector, label in rows:
        if at is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        row = label, [math.floor(256 * float(np.float32(x))) for x in vector]
        whole[at] = min(whole.get(at, row), row)
    out = []
    for anchor, (label, q) in whole.items():
        if anchor % anchors:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(q, v)), at, own == label) for at, (own, v) in whole.items() if at != anchor
        )
        for score, positive, _ in [s for s in scored if s[2]][:positives]:
            p = -score
            fit = [(at, -s) for s, at, same in scored if not same and 30 * p <= -100 * s <= 90 * p][:negatives]
            out += [(anchor, positive, i + 1, at, p, s) for i, (at, s) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, **options):
    return sorted(tuple(r) for r in mine(table(spark, rows), F.col("id") % 100 == 0, **options).collect())


def clustered(n, seed, width=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, width))
    vectors = centres[rng.integers(0, 4, n)] + 0.7 * rng.normal(size=(n, width))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    return [(i, [float(x) for x in v], int(k)) for i, (v, k) in enumerate(zip(vectors, rng.integers(0, 3, n)))]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed, monkeypatch):
    # Small groups and blocks: several of each take part.
    monkeypatch.setattr(hard_negatives, "GROUP", 3)
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", 64)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 2)
    rows = clustered(700, seed)
    found = mined(spark, rows)
    assert found == expected(rows) and len(found) > 150


def test_ties_copies_and_scattered_lengths(spark):
    rows = [(i, [1.0, 0.5, 0.0], 0) for i in range(60)] + [(i, [0.7, 0.3], 1) for i in range(60, 230)]
    rows += [(300 + i, [0.1 * i, 0.0, 0.0], 2) for i in range(10)] + [(400, [], 1), (500, [0.0], 0)]
    assert mined(spark, rows) == expected(rows)


def test_nulls_gaps_repeated_rows_and_large_numbers(spark):
    rows = clustered(230, 5, width=6)
    rows += [(1000, None, 1), (1001, [1.0, None], 1), (1002, [float("nan")], 1), (1003, [float("inf")], 0)]
    rows += [(1004, [1.0] * 6, None), (None, [1.0] * 6, 1), rows[3], rows[100], (7, [0.5] * 6, 9)]
    assert mined(spark, rows) == expected(rows)
    large = [(i, [1e6 * (1 + i % 7), 3e5 * (i % 3)], i % 2) for i in range(40)]
    assert mined(spark, large) == expected(large) != []
    # Products beyond 64 bits stop at the largest.
    assert mined(spark, [(i, [1e9 * (1 + i % 7)], i % 2) for i in range(40)]) is not None
    assert mined(spark, []) == [] and mined(spark, rows[1:9]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [2.0], 2)]) == []
    negative = [(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.5], 2), (3, [0.5], 2)]
    assert mined(spark, negative) == expected(negative) == []


def test_thresholds_prune_and_lose_nothing():
    """A block's pairs are all those above the thresholds, and most are never scored to the end."""
    rng = np.random.default_rng(9)
    vectors = rng.integers(-80, 80, (900, 40)) * (rng.random(40) ** 2 + 0.05)
    vectors = vectors.astype(np.int64)
    vectors[600:] //= 5
    anchors = vectors[:50]
    n = np.arange(50)
    own = (anchors**2).sum(1)
    group = hard_negatives.Anchors(n, n % 2, anchors, n, own // 2, np.full(50, hard_negatives.HIGHEST), n, 5, True)
    join = hard_negatives.ThresholdJoin(group)
    x = vectors[:, join.order].astype(float)
    t = join._thresholds()
    lowest = (t / join.q_norms[:, -1]).min()
    norms = join._prefix_norms(x)
    rows, columns, scores = join._pairs(x, norms, n, t, lowest)
    whole = vectors @ anchors.T
    assert sorted(zip(rows, columns, scores)) == sorted(zip(*np.nonzero(whole >= t), whole[whole >= t]))
    assert (norms[:, -1] < lowest).any() and ((norms[:, 1] < lowest) & (norms[:, -1] >= lowest)).any()
