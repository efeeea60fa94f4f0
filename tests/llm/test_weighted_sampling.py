import hashlib
from collections import Counter

import numpy as np
import pytest
from odd_rows import ODD

from passagelake.llm import weighted_sampling
from passagelake.llm.queries import op8_weighted_sampling
from passagelake.llm.weighted_sampling import Sampler, compare_with_next, fingerprints, likeness

SF = "/root/testdata/sf0.001"


def jaccard(a, b):
    """Generalised Jaccard similarity of two texts' words."""
    a, b = Counter(a.lower().split()), Counter(b.lower().split())
    most = sum((a | b).values())
    return sum((a & b).values()) / most if most else 1.0


def test_collision_rate_is_generalised_jaccard():
    sampler = Sampler(4096)
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(200)]
    for share in (0.1, 0.5, 0.9):
        a = rng.choice(words, 300).tolist()
        b = [w if rng.random() < share else rng.choice(words) for w in a]
        a, b = " ".join(a + ["hot"] * 40), " ".join(b + ["hot"] * 7)
        first, second = sampler.signatures([a, b])
        assert likeness(first, second) == pytest.approx(jaccard(a, b), abs=0.035)


def expected_rows(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    for k, (at, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 3
        yield at, text, text[: len(text) - cut] + following[:cut], following


def check(got, rows):
    expected = [
        (at, len(text), hashlib.sha256(changed.encode()).hexdigest()) for at, text, changed, _ in expected_rows(rows)
    ]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted([tuple(r)[:3] for r in got], key=key) == sorted(expected, key=key)


@pytest.mark.parametrize("partitions", [1, 7])
def test_query_edits_with_the_next_document(spark, partitions):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = op8_weighted_sampling(spark, SF).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    check(got, rows)
    near = {r["doc_id"]: r for r in got}
    errors = []
    for at, text, changed, following in expected_rows(rows):
        errors.append(near[at]["near_edited"] - jaccard(text, changed))
        errors.append(near[at]["near_next"] - jaccard(text, following))
    assert np.abs(errors).max() < 0.25 and abs(np.mean(errors)) < 0.01
    by_text = {}
    for at, text in rows:
        assert by_text.setdefault(text, near[at]["fingerprint"]) == near[at]["fingerprint"]


def test_odd_rows(spark, make_docs):
    got = compare_with_next(make_docs(ODD)).collect()
    check(got, ODD)
    empty = next(r for r in got if r["doc_id"] == 1)
    assert (empty["n_chars"], empty["fingerprint"], empty["near_edited"]) == (0, "", 1.0)
    assert compare_with_next(make_docs([])).count() == 0
    alone = compare_with_next(make_docs(["just one text here"])).collect()
    check(alone, [(0, "just one text here")])
    assert alone[0]["near_next"] == 1.0
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprints(make_docs(ODD)).collect()}
    assert prints[8] == prints[9] != prints[5] and prints[0] == ""


@pytest.mark.parametrize("partitions", [1, 5, 8])
def test_equal_ids_are_ordered_by_text_however_they_are_dealt(spark, make_docs, partitions):
    rows = [(7 if i % 2 else i, f"{'same start ' * (i % 3)}text {i * 37 % 101}") for i in range(60)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        check(compare_with_next(make_docs(rows).repartition(4)).collect(), rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_signatures_do_not_depend_on_how_many_words_are_drawn_at_once(monkeypatch):
    texts = [" ".join(f"w{i * k % 97}" for i in range(n)) for k, n in enumerate([0, 1, 3, 90, 400, 1200], 2)] + [None, "a a b"]
    drawn, draws = [], weighted_sampling._draws
    monkeypatch.setattr(weighted_sampling, "_draws", lambda hashes, samples: drawn.append(len(hashes)) or draws(hashes, samples))
    found = []
    for size in (weighted_sampling.DRAWN_WORDS, 1, 7, 5000):
        monkeypatch.setattr(weighted_sampling, "DRAWN_WORDS", size)
        drawn.clear()
        found.append([weighted_sampling.packed(s) for s in weighted_sampling.Sampler().signatures(texts)])
        assert max(drawn) <= size and sum(drawn) == len({w for t in texts for w in (t or "").split()})
    assert all(f == found[0] for f in found)
