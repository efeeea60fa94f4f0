import math
import zlib
from collections import Counter

import numpy as np
import pytest
from odd_rows import ODD

from passagelake.llm.queries import op6_suffix_tree
from passagelake.llm import suffix_tree
from passagelake.llm.suffix_tree import (
    DEPTH,
    GAIN,
    LEAST_SEEN,
    Suffixes,
    count_corpus,
    divergences,
    grow_tree,
    levels,
    score,
    spelled,
    tokens,
    windows,
)

SF = "/root/testdata/sf0.001"


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 10 == 0


def slow_base(texts, training):
    counts = Counter()
    for text in training:
        counts.update([*(text or "").encode().lower().split(), b"\n"])
    total, distinct = sum(counts.values()), len(counts)
    out = {}
    for i, text in texts.items():
        words = [*(text or "").encode().lower().split(), b"\n"]
        logs = [math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words]
        out[i] = len(words), sum(counts[w] > 0 for w in words), total, sum(logs)
    return out


def test_query_base_scores_equal_brute_force(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    training = [t for i, t in texts.items() if not held_out(i)]
    slow = slow_base(texts, training)
    tree = SlowTree(training, LEAST_SEEN, GAIN)
    rows = op6_suffix_tree(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for row in rows:
        assert row["held_out"] == held_out(row["doc_id"])
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == slow[row["doc_id"]][:3]
        assert row["base_score"] == pytest.approx(slow[row["doc_id"]][3], rel=1e-9)
    for row in sorted(rows, key=lambda r: len(texts[r["doc_id"]] or ""))[:60]:
        assert row["score"] == pytest.approx(tree.score(texts[row["doc_id"]]), rel=1e-6)


TEXTS = ["abracadabra abra", "a cat sat on a mat", "the cat ate the rat", "", "über öl", "a cat sat on a mat"] * 20


class SlowTree:
    """All contexts, one byte after the other."""

    def __init__(self, training, least, gain):
        self.counts = {}
        for text in training:
            data = b"\n" * DEPTH + spelled(tokens(text))
            for at in range(DEPTH, len(data)):
                for depth in range(DEPTH + 1):
                    self.counts.setdefault(data[at - depth : at], Counter())[data[at]] += 1
        self.totals = {c: sum(n.values()) for c, n in self.counts.items()}
        diverging = [c for c in self.counts if c and self.totals[c] >= least and self.gain(c) >= gain]
        self.kept = {b""} | {c[i:] for c in diverging for i in range(len(c))}

    def gain(self, context):
        before, total = context[1:], self.totals[context]
        return sum(
            n * math.log(n / total / (self.counts[before][b] / self.totals[before]))
            for b, n in self.counts[context].items()
        )

    def probability(self, context, byte):
        before = self.probability(context[1:], byte) if context else 1 / 256
        counts = self.counts.get(context, Counter())
        weight = max(1, len(counts)) if context else 1
        return (counts[byte] + weight * before) / (self.totals.get(context, 0) + weight)

    def score(self, text):
        data, total = b"\n" * DEPTH + spelled(tokens(text)), 0.0
        for at in range(DEPTH, len(data)):
            context = next(data[at - d : at] for d in range(DEPTH, -1, -1) if data[at - d : at] in self.kept)
            total += math.log10(self.probability(context, data[at]))
        return total


@pytest.fixture(scope="module")
def grams(spark, make_docs):
    return count_corpus(make_docs(TEXTS)).where("gram is not null").select("gram", "n")


def test_contexts_and_divergences(grams):
    slow = SlowTree(TEXTS, 1, 0)
    counted = levels(grams)
    for depth, level in enumerate(counted):
        rows = level.collect()
        got = {r["gram"].to_bytes(depth + 1, "big"): r["n"] for r in rows}
        assert got == {c + bytes([b]): n for c, own in slow.counts.items() if len(c) == depth for b, n in own.items()}
        for r in rows:
            context = r["context"].to_bytes(depth, "big")
            assert (r["total"], r["ways"]) == (slow.totals[context], len(slow.counts[context]))
        if depth:
            gains = divergences(level, counted[depth - 1], depth, 21).collect()
            assert {r["context"].to_bytes(depth, "big") for r in gains} == {
                c for c, n in slow.totals.items() if len(c) == depth and n >= 21
            }
            for r in gains:
                assert r["gain"] == pytest.approx(slow.gain(r["context"].to_bytes(depth, "big")), abs=1e-6)


@pytest.mark.parametrize("parts", [1, 3])
def test_scores_follow_the_longest_kept_suffix(grams, parts):
    tree = grow_tree(grams, least=21, gain=5.0)
    slow = SlowTree(TEXTS, 21, 5.0)
    kept = {r["context"].to_bytes(r["depth"], "big") for r in tree.contexts.collect()}
    assert kept == slow.kept and len(kept) < len(slow.counts)
    held = [Suffixes.collected(tree, part, parts) for part in range(parts)]
    texts = ["a cat ate", "zebra ☃", "", "abracadabra " * 300]
    got = sum(h.scores([spelled(tokens(t)) for t in texts], part, parts) for part, h in enumerate(held))
    assert got == pytest.approx([slow.score(t) for t in texts], rel=1e-5)
    # Behind every context, the chances of all bytes add up to one.
    if parts == 1:
        for context in sorted(kept):
            key = int.from_bytes(context.rjust(DEPTH, b"~"), "big")
            assert (10.0 ** held[0].log10(np.arange(256) | key << 8)).sum() == pytest.approx(1, abs=1e-4)


def test_windows_in_pieces_are_those_of_whole_streams(monkeypatch):
    streams = [spelled(tokens(t)) for t in [*TEXTS, "long " * 500, ""]]
    whole = [(o, k) for owners, keys in windows(streams) for o, k in zip(owners.tolist(), keys.tolist())]
    monkeypatch.setattr(suffix_tree, "WINDOW_BYTES", 64)
    pieces = [(o, k) for owners, keys in windows(streams) for o, k in zip(owners.tolist(), keys.tolist())]
    assert pieces == whole and len(whole) == sum(map(len, streams))


def test_more_text_keeps_more_contexts(spark):
    """No limit is a share of the corpus: what a part of it keeps, the whole keeps, and more."""
    sizes = []
    for folder in ("sf0.001", "sf0.01"):
        docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
        counted = count_corpus(docs).where("gram is not null").select("gram", "n")
        sizes.append(grow_tree(counted).contexts.count())
    assert sizes[1] > 1.5 * sizes[0]


def test_rare_words_parts_and_the_end(spark, make_docs, monkeypatch):
    """Words under the share that is sent are joined; the end is known however rare; parts add up."""
    docs = make_docs([" ".join(f"w{(i * j) % 97}" for j in range(60)) for i in range(40)])
    whole = {r["doc_id"]: r for r in score(docs, docs.where("doc_id < 30")).collect()}
    monkeypatch.setattr(suffix_tree, "COMMON_SHARE", 0.05)
    monkeypatch.setattr(suffix_tree, "PART_ENTRIES", 100)
    rows = score(docs, docs.where("doc_id < 30")).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    slow = slow_base(texts, [t for i, t in texts.items() if i < 30])
    for row in rows:
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == slow[row["doc_id"]][:3]
        assert row["base_score"] == pytest.approx(slow[row["doc_id"]][3], rel=1e-9)
        assert row["score"] == pytest.approx(whole[row["doc_id"]]["score"], rel=1e-6)


def test_a_trained_model_likes_its_language(spark, make_docs):
    docs = make_docs(["the cat sat on the mat and the rat"] * 200 + [(900, "the rat sat on the cat"), (901, "xqz vwk jjq")])
    rows = {r["doc_id"]: r for r in score(docs, docs.where("doc_id < 900")).collect()}
    assert rows[900]["score"] / rows[900]["n_tokens"] > rows[901]["score"] / rows[901]["n_tokens"] + 3


def test_odd_rows(spark, make_docs):
    docs = make_docs(ODD)
    rows = score(docs, docs.where("doc_id <> 4")).collect()
    assert len(rows) == len(ODD)
    texts = {i: t for i, t in ODD if i is not None}
    slow = slow_base(texts, [t for i, t in ODD if i is not None and i != 4])
    for row in rows:
        assert math.isfinite(row["score"])
        if row["doc_id"] is not None:
            assert row["base_score"] == pytest.approx(slow[row["doc_id"]][3], rel=1e-9)
    assert score(make_docs([]), make_docs([])).count() == 0
    untrained = score(make_docs(["a b"]), make_docs([])).collect()[0]
    assert (untrained["n_tokens"], untrained["n_known"], untrained["train_tokens"]) == (3, 0, 0)
    assert untrained["score"] == pytest.approx(-4 * math.log10(256), rel=1e-4)
