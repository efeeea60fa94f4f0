import hashlib
from collections import Counter

import numpy as np
import pytest
from odd_rows import ODD

from passagelake.llm import token_alignment
from passagelake.llm.queries import op13_token_alignment, tokenizer_path
from passagelake.llm.token_alignment import Aligner, align, terminals

SF = "/root/testdata/sf0.001"
A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
MORE = [
    "<s> x </s> <unk> <0x41>", "\u2581 \u2581\u2581a b", "a  b   c", "\t x", "\nfoo\nbar baz", "x\u2581y", " ", "  ",
    "<|endoftext|>", "a " * 10, "don't it's 's", "\u00e9 \u00e0 \u65e5\u672c \U0001f389", "word, " * 300,
]


@pytest.fixture(scope="module")
def library():
    """Groups of a text by the libraries, cut one after the other; None without tokens."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    tokenizer, model = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    tokenizer.encode_special_tokens = True
    table = Aligner(A, B)

    def groups(text):
        if not text:
            return None
        whole = (" " + text).encode()
        a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
        spelled = [table.a_bytes[i] for i in a], [table.b_bytes[i] for i in b]
        if any(b"".join(s) != whole for s in spelled):
            return None
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in spelled]
        out, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            group = [], []
            while i < len(a) and ends[0][i] <= cut:
                group[0].append(a[i])
                i += 1
            while j < len(b) and ends[1][j] <= cut:
                group[1].append(b[j])
                j += 1
            out.append(group)
        return out

    return groups


def expected(library, rows):
    found = [(at, library(text)) for at, text in rows]
    links = [Counter((x, y) for g in groups or [] for x in g[0] for y in g[1]) for _, groups in found]
    counts = Counter(pair for link in links for pair in link)
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    for (at, groups), link in zip(found, links):
        if groups is None:
            yield at, 0, 0, 0, 0, 0, 0, ""
            continue
        shown = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        yield (
            at, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(link.values()),
            sum(n for (a, b), n in link.items() if counts[a, b] == best[a]),
            sum(n * counts[pair] for pair, n in link.items()), hashlib.sha256(shown.encode()).hexdigest(),
        )


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r))


def by_library(library, rows):
    return order(expected(library, rows))


def test_query_equals_the_libraries(spark, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert order(op13_token_alignment(spark, SF).collect()) == by_library(library, rows)


@pytest.mark.parametrize("small", [False, True])
def test_odd_texts(spark, make_docs, library, monkeypatch, small):
    if small:
        # Several parts of the counts, counted in several goes.
        monkeypatch.setattr(token_alignment, "PART_PAIRS", 400)
        monkeypatch.setattr(token_alignment, "COUNTED_PAIRS", 50)
    rows = [r for r in ODD if r[0] is not None] + [(100 + i, t) for i, t in enumerate(MORE)] + [(103, MORE[3])]
    assert order(align(make_docs(rows).repartition(3), A, B).collect()) == by_library(library, rows)
    nulls = align(make_docs([(None, "no id"), (None, None)]), A, B).collect()
    assert sorted((r.doc_id, r.n_groups > 0) for r in nulls) == [(None, False), (None, True)]
    assert align(make_docs([]), A, B).count() == 0


def test_words_forgotten_or_not_cut_give_the_same(library, monkeypatch):
    monkeypatch.setattr(token_alignment, "CACHED_WORDS", 5)
    monkeypatch.setattr(token_alignment, "LEARNED_WORDS", 3)
    texts = [t for _, t in ODD if t and len(t) < 5000] + MORE
    by_word, whole = Aligner(A, B), Aligner(A, B)
    whole.by_word = False
    first = by_word.align(texts, keep_groups=True)
    assert first == by_word.align(texts, keep_groups=True) == whole.align(texts, keep_groups=True)
    for text, groups in zip(texts, first["groups"]):
        assert (groups is None) == (library(text) is None)


def test_pointers_reach_the_ends_of_components():
    rng = np.random.default_rng(4)
    for _ in range(300):
        total = int(rng.integers(1, 60))
        a, b = (np.unique(np.append(rng.integers(1, total + 1, rng.integers(1, 30)), total)) for _ in "ab")
        shared = np.intersect1d(a, b)
        ends = shared[np.searchsorted(shared, np.concatenate([a, b]))]
        assert (b[terminals(a, b)] == ends).all()
    # A chain through all tokens.
    a, b = np.append(np.arange(2, 20_000, 2), 20_001), np.append(np.arange(1, 20_001, 2), 20_001)
    assert (terminals(a, b) == len(b) - 1).all()
