import random
from collections import Counter

import numpy as np
import pytest
from odd_rows import ODD

from passagelake.llm import decontamination
from passagelake.llm.decontamination import (
    PARAPHRASE,
    SAME,
    ANSWER,
    answer_of,
    common_subsequence,
    contaminations,
    item_windows,
    words_of,
)
from passagelake.llm.queries import op5_decontamination

SF = "/root/testdata/sf0.01"


def slow_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(row[-1], before[j + 1]))
    return row[-1]


def test_subsequences():
    rng = random.Random(1)
    for _ in range(300):
        a, b = (rng.choices("abcde", k=rng.randrange(0, 90)) for _ in range(2))
        assert common_subsequence(a, b) == slow_subsequence(a, b)


def test_whole_items_in_documents_are_found_and_clean_ones_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    held = {(d["doc_id"], i["item_id"]) for d in docs for i in items if i["text"] in d["text"]}
    got = {(r["doc_id"], r["item_id"]): r["overlap"] for r in op5_decontamination(spark, SF).collect()}
    assert held and held <= set(got)
    # By brute force: whatever else is reported holds the item's words in order.
    texts, questions = {d["doc_id"]: d["text"] for d in docs}, {i["item_id"]: i["text"] for i in items}
    for doc, item in set(got) - held:
        words = words_of(questions[item])
        share = slow_subsequence(words, words_of(texts[doc])) / len(words)
        assert share >= SAME or share >= PARAPHRASE


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    common = [f"w{i}" for i in range(60)]
    rare = [f"r{i}" for i in range(4000)]

    def prose(n):
        return [rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(n)]

    items = [" ".join(prose(rng.randrange(12, 70))) + ". " + " ".join(prose(5)) + "." for _ in range(40)]
    docs, planted = [], set()
    for i in range(400):
        words = prose(rng.randrange(30, 600))
        if i % 4 == 0:
            item = rng.randrange(len(items))
            copied = items[item].replace(".", "").split()
            if i % 8 == 0:  # a paraphrase: words changed, the answer kept
                body = [w if rng.random() > 0.12 else "changed" for w in copied[:-5]]
                copied = body + copied[-5:]
            at = rng.randrange(len(words))
            words[at:at] = copied
            planted.add((i, item))
        docs.append(" ".join(words))
    return docs, items, planted


def test_recall_against_brute_force(spark, make_docs, corpus):
    docs, items, planted = corpus
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contaminations(make_docs(docs), benchmark).collect()}
    brute = set()
    for i, item in enumerate(items):
        words, answer = words_of(item), answer_of(item)
        for d, text in enumerate(docs):
            other = words_of(text)
            # A subsequence has no more words than both have in common, each as often as in both.
            if sum((Counter(words) & Counter(other)).values()) < PARAPHRASE * len(words):
                continue
            for at in range(0, len(other), 16):
                region = other[max(0, at - len(words)) : at + 48 + len(words)]
                share = common_subsequence(words, region) / len(words)
                kept = common_subsequence(answer, region) >= ANSWER * len(answer)
                if share >= SAME or share >= PARAPHRASE and kept:
                    brute.add((d, i))
    assert got <= brute
    assert len(planted & brute) >= 0.9 * len(planted)
    assert len(got) >= 0.95 * len(brute)
    assert not {d for d, _ in got} - {d for d, _ in planted}


def test_odd_rows(spark, make_docs):
    benchmark = spark.createDataFrame(
        [(1, "same text again and again"), (2, None), (3, ""), (None, "no id at all here"), (4, "one two")],
        "item_id bigint, text string",
    )
    got = contaminations(make_docs(ODD), benchmark).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got if r["item_id"] == 1) == [(8, 1), (8, 1), (9, 1)]
    assert len({r["row_id"] for r in got if r["item_id"] == 1}) == 3
    assert (None, None) in {(r["doc_id"], r["item_id"]) for r in got}
    assert contaminations(make_docs([]), benchmark).count() == 0
    assert contaminations(make_docs(ODD), benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("size", [200, 400, 800, 1000])
def test_exact_copies_of_long_items_are_found(spark, make_docs, size):
    rng = np.random.default_rng(size)
    chances = 1 / np.arange(1, 8001)
    chances /= chances.sum()

    def prose(n):
        return [f"z{i}" for i in rng.choice(8000, n, p=chances)]

    items = [prose(size) for _ in range(40)]
    docs, planted = [], set()
    for i in range(200):
        words = prose(int(rng.integers(50, 500)))
        if i % 2:
            item = int(rng.integers(len(items)))
            at = int(rng.integers(len(words)))
            words[at:at] = items[item]
            planted.add((i, item))
        docs.append(" ".join(words))
    benchmark = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(items)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["overlap"] for r in contaminations(make_docs(docs), benchmark).collect()}
    assert planted == set(got)
    assert set(got.values()) == {1.0}


def test_windows_of_items_cover_them():
    for size in (1, 47, 48, 49, 60, 96, 500):
        windows = item_windows(size)
        assert windows[0][0] == 0 and windows[-1][1] == size
        assert {at for a, b in windows for at in range(a, b)} == set(range(size))
        assert len(set(windows)) == len(windows)


def test_paraphrases_of_items_that_repeat_words_are_found(spark, make_docs):
    # 40 words, 28 of them different: 16 that stand once are changed, the answer is kept.
    body = [f"once{i}" for i in range(22)] + ["often", "again"] * 6 + ["often"]
    random.Random(3).shuffle(body)
    answer = ["often", "the", "last", "five", "words"]
    item = " ".join(body) + ". " + " ".join(answer) + "."
    words = words_of(item)
    assert len(words) == 40 and len(set(words)) == 28
    changed = [w if not w.startswith("once") or int(w[4:]) >= 16 else "changed" for w in body]
    rng = random.Random(5)

    def prose(n):
        return [f"other{rng.randrange(500)}" for _ in range(n)]

    texts = [" ".join(prose(60) + (changed + answer if i % 2 else []) + prose(60)) for i in range(40)]
    benchmark = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = {r["doc_id"] for r in contaminations(make_docs(texts), benchmark).collect()}
    brute = set()
    for i, text in enumerate(texts):
        share = slow_subsequence(words, words_of(text)) / len(words)
        kept = slow_subsequence(answer_of(item), words_of(text)) >= ANSWER * len(answer_of(item))
        if share >= SAME or share >= PARAPHRASE and kept:
            brute.add(i)
    assert brute == set(range(1, 40, 2))
    assert got == brute


@pytest.mark.parametrize("at_once", [1 << 18, 300, 1])
def test_words_in_common_are_counted_for_all_candidates_at_once(monkeypatch, at_once):
    monkeypatch.setattr(decontamination, "REGION_WORDS", at_once)
    draw = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    # Items of few and of more than 64 different words, with repeated ones.
    words = [[w.encode() for w in draw.choice(vocabulary, size=n)] for n in (3, 20, 48, 90, 300)]
    items = decontamination.Items(list(range(5)), words, words)
    retriever = decontamination.Retriever(items, np.ones((len(items.vocabulary), 1), np.float32))
    texts = ["", None, "x y z"] + [" ".join(draw.choice([*vocabulary, "unknown"], size=draw.integers(1, 900))) for _ in range(20)]
    texts += [b" ".join(w).decode() for w in words]
    passages = decontamination.Passages(texts, items.vocabulary)
    steps = draw.integers(passages.steps, size=600)
    text, item = np.searchsorted(passages.first, steps, side="right") - 1, draw.integers(5, size=600)
    start = (steps - passages.first[text]) * decontamination.STEP
    expected = []
    for t, i, s in zip(text, item, start):
        around = len(words[i]) + 2 * decontamination.STEP
        region = passages.words[t][max(0, s - around) : s + decontamination.WINDOW + around]
        expected.append(sum(w in region for w in words[i]) >= decontamination.PARAPHRASE * len(words[i]))
    got = retriever.possible(passages, text, item, start)
    assert got.tolist() == expected and 0 < sum(expected) < 600
    none = np.empty(0, dtype=np.int64)
    assert not len(retriever.possible(passages, none, none, none))
