import re

import numpy as np
import xxhash
from odd_rows import ODD
from pyspark.sql import functions as F

from passagelake.llm import simhash as module
from passagelake.llm.graph import connected_components
from passagelake.llm.queries import op3_simhash
from passagelake.llm.simhash import chain_keys, fingerprint_classes, near_duplicates, simhash, within_budgets

SF = "/root/testdata/sf0.001"


def slow_simhash(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """Smallest reachable id of each (id, print) by looking at all pairs."""
    parent = {i: i for i, _ in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in prints:
        for j, b in prints:
            if i < j and (a ^ b).bit_count() <= 3:
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    return {i: find(i) for i, _ in prints}


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def test_query_equals_brute_force(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    prints = [(i, slow_simhash(t)) for i, t in texts.items()]
    components = slow_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op3_simhash(spark, SF).collect()}
    assert got == {i: (f"{p:016x}", components[i]) for i, p in prints}


def test_dense_families_and_chains(spark):
    rng = np.random.default_rng(3)
    prints, centre = set(), int(rng.integers(1 << 63))
    for _ in range(300):  # a dense family
        flips = rng.choice(64, size=rng.integers(0, 4), replace=False)
        prints.add(centre ^ sum(1 << int(b) for b in flips))
    link = int(rng.integers(1 << 63))
    for step in range(20):  # a chain of steps of three bits
        prints.add(link)
        link ^= sum(1 << int(b) for b in rng.choice(64, size=3, replace=False))
    for _ in range(300):
        prints.add(int(rng.integers(1 << 63)) * 2 + 1)
    near = centre
    for bit in range(4):  # four bits away from another: no link by itself
        near ^= 1 << bit
    prints.add(near)
    numbered = sorted((signed(p), p) for p in prints)
    frame = spark.createDataFrame([(s,) for s, _ in numbered], "fp bigint")
    classes = {r["fp"]: r["class_fp"] for r in fingerprint_classes(frame).collect()}
    slow = slow_components(numbered)
    groups, expected = {}, {}
    for s, _ in numbered:
        groups.setdefault(classes.get(s, s), set()).add(s)
        expected.setdefault(slow[s], set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_every_pair_within_three_bits_shares_a_key_that_passes(spark):
    rng = np.random.default_rng(5)
    pairs = []
    for _ in range(2000):
        a = int(rng.integers(1 << 63)) * 2 + int(rng.integers(2))
        flips = rng.choice(64, size=rng.integers(1, 6), replace=False)
        b = a ^ sum(1 << int(x) for x in flips)
        pairs.append((signed(a), signed(b), len(flips)))
    frame = spark.createDataFrame(pairs, "a bigint, b bigint, d int")
    keys = frame.select("a", "b", "d", F.explode(F.array_intersect(chain_keys(F.col("a")), chain_keys(F.col("b")))).alias("k"))
    passed = keys.where(within_budgets(F.col("a"), F.col("b"), F.col("k"))).select("a", "b", "d").distinct()
    assert passed.count() == frame.where("d <= 3").distinct().count()
    assert passed.where("d > 3").count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, 500 + i) for i in range(50)] + [(9, 9)]
    rows = connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    got = {r["node"]: r["component"] for r in rows}
    assert got == {i: 100 for i in range(100, 141)} | {500 + i: 7 for i in range(50)} | {7: 7}


def test_odd_rows(spark, make_docs):
    rows = near_duplicates(make_docs(ODD)).collect()
    assert len(rows) == len(ODD)
    zero = [r for r in rows if r["fp"] == 0]
    assert len(zero) == 4 and {r["component_id"] for r in zero} == {0}  # null, empty, blank, null id
    assert [r["component_id"] for r in rows if r["doc_id"] in (8, 9)] == [8, 8, 8]
    assert near_duplicates(make_docs([])).count() == 0
    only_null = near_duplicates(make_docs([(None, "x y z")])).collect()
    assert only_null[0]["component_id"] is None
    for _, text in ODD:
        if len(text or "") < 1000:
            assert simhash(text) == slow_simhash(text)


def test_rows_of_all_documents_or_keys_are_not_broadcast(spark, monkeypatch):
    """Files of repeated values are small, so Spark would send their rows to the driver."""
    plans = []
    real = module.connected_components
    monkeypatch.setattr(module, "connected_components", lambda edges: (plans.append(plan(edges)), real(edges))[1])
    monkeypatch.setattr(module, "fingerprints", lambda docs, *a: docs)

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    rng = np.random.default_rng(7)
    prints = [int(p) ^ 1 << int(b) for p in rng.integers(0, 1 << 62, 20) for b in rng.integers(0, 62, 5)]
    rows = [(i, p) for i, p in enumerate(prints * 3)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, fp bigint"))
    across = plans[-1]
    assert "SortMergeJoin" in across and "Broadcast" not in across
    last = next(line for line in plan(found).splitlines() if "Join" in line)
    assert "SortMergeJoin" in last
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == slow_components(rows)
