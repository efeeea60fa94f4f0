import zlib

import numpy as np
import pytest
from odd_rows import ODD

from passagelake.llm.cross_parsing import (
    SAMPLE_DOCS,
    UNDETERMINED,
    Model,
    build_model,
    identify,
    letters_only,
    sample_rows,
    suffix_automaton,
    train,
)
from passagelake.llm.queries import op10_cross_parsing

SF = "/root/testdata/sf0.01"


def test_automaton_knows_all_substrings_and_no_others():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 3, 60).astype(np.uint8)
    table = suffix_automaton(text, 3)
    whole = bytes(text)
    for length in range(1, 8):
        for _ in range(60):
            word = bytes(rng.integers(0, 3, length).astype(np.uint8))
            state = 0
            for symbol in word:
                state = table[state, symbol] if state >= 0 else -1
            assert (state >= 0) == (word in whole)


def test_phrases_are_the_greedy_parsing():
    rng = np.random.default_rng(2)
    reference = rng.integers(0, 4, 200).astype(np.uint8)
    model = Model(["x"], np.zeros(1, np.uint8), [suffix_automaton(reference, 6)], np.ones(1))
    blocks = [rng.integers(0, 5, n).astype(np.uint8) for n in (1, 3, 50, 400, 50)]
    for block, count in zip(blocks, model.phrases(blocks)[0]):
        phrases, start, whole = 0, 0, bytes(block)
        while start < len(whole):
            end = start + 1
            while end < len(whole) and whole[start : end + 1] in bytes(reference):
                end += 1
            phrases += 1
            # A symbol that the reference lacks stays open and is joined by the phrase behind it.
            start = end
        missing = sum(1 for s in whole if bytes([s]) not in bytes(reference))
        assert phrases - missing <= count <= phrases + 1


def test_held_out_accuracy(spark):
    rows = op10_cross_parsing(spark, SF).collect()
    lang = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect())
    assert sorted(r["doc_id"] for r in rows) == sorted(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) > 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_sample_is_bounded_and_does_not_count_copies(spark, make_docs):
    docs = make_docs(["copy of one text"] * 500 + [f"text number {i}" for i in range(300)])
    rows = sample_rows(docs).collect()
    assert len(rows) == SAMPLE_DOCS == len({r["text"] for r in rows})


@pytest.fixture(scope="module")
def model():
    return build_model({"en": ["the cat and the dog were on the hill when it rained"] * 20, "de": ["der hund und die katze waren auf dem berg als es regnete"] * 20})


def test_odd_rows(spark, make_docs, model):
    rows = identify(make_docs(ODD + [(20, "1234 !? 56")]), model).collect()
    assert len(rows) == len(ODD) + 1
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    for at in (0, 1, 2, 20):
        assert got[at] == (UNDETERMINED, 0.0)
    for at in (3, 6, 7, 12):
        assert got[at][0] in ("en", "de") and 0 <= got[at][1] <= 1
    assert identify(make_docs([]), model).count() == 0
    assert model.classify(["the dog and the cat", "der hund und die katze"])[0] == ["en", "de"]
    assert letters_only("A1b_ÉÜ-ćd 漢") == "a b éü c d 漢"


def test_without_labels_everything_is_undetermined(spark, make_docs):
    empty = train(make_docs(["a text"], lang=None))
    assert empty.classify(["a text", None]) == ([UNDETERMINED] * 2, [0.0] * 2)
    one = train(make_docs(["only one language here"]))
    assert one.classify(["some text"]) == (["en"], [1.0])


def test_phrases_are_counted_exactly():
    rng = np.random.default_rng(3)
    reference = rng.integers(0, 4, 200).astype(np.uint8)
    model = Model(["x"], np.zeros(1, np.uint8), [suffix_automaton(reference, 6)], np.ones(1))
    blocks = [rng.integers(0, 6, n).astype(np.uint8) for n in (1, 3, 50, 400, 50)] + [np.full(9, 5, np.uint8)]
    for block, count in zip(blocks, model.phrases(blocks)[0]):
        phrases, start, whole = 0, 0, bytes(block)
        while start < len(whole):
            end = start + 1
            while end < len(whole) and whole[start : end + 1] in bytes(reference):
                end += 1
            phrases += 1
            start = end
        assert count == phrases


def test_languages_of_many_scripts_are_told_apart():
    # Seventy frequent Latin letters, then scripts with few samples of their own.
    latin = "".join(chr(c) for c in range(0xE0, 0x150) if chr(c).islower())
    words = {
        "la": " ".join(latin[i : i + 4] for i in range(len(latin) - 4)),
        "ru": "кошка и собака были на холме когда пошёл дождь",
        "bg": "котката и кучето бяха на хълма когато заваля дъжд",
        "el": "η γάτα και ο σκύλος ήταν στον λόφο όταν έβρεξε",
        "zh": "下雨的时候猫和狗在山上",
        "ja": "雨が降ったとき猫と犬は丘の上にいた",
        "ko": "비가 왔을 때 고양이와 개는 언덕 위에 있었다",
    }
    model = build_model({k: [v] * (200 if k == "la" else 20) for k, v in words.items()})
    assert model.classify(list(words.values()))[0] == list(words)
    parts = {"ru": "собака и кошка", "bg": "кучето и котката", "el": "ο σκύλος και η γάτα", "ja": "犬と猫は丘の上", "zh": "狗和猫在山上"}
    assert model.classify(list(parts.values()))[0] == list(parts)


def test_numerals_are_no_letters():
    from passagelake.llm.cross_parsing import build_model, letters_only

    assert letters_only("½ ² ① Ⅷ 5") == "" and letters_only("x²y Ⅷth ÜB_er") == "x y th üb er"
    model = build_model({"a": ["some text of one language"], "b": ["ganz anderer text"]})
    assert model.classify(["½ ² ①", "some text"])[0] == ["und", "a"]
