import random
import re

from odd_rows import ODD

from passagelake.llm.licenses import (
    BLOCK_STEP,
    BLOCK_WORDS,
    TEMPLATES,
    label_documents,
    required,
    scan,
    words_of,
)
from passagelake.llm.queries import op4_license_scan

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def slow_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow_base(text):
    words, starts, labels = slow_words(text), [], set()
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(parts)] == parts:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def slow_matches(text):
    """(template, first word of the block, containment) by looking at all blocks and templates."""
    words, found = slow_words(text), set()
    for start in range(0, max(1, len(words) - BLOCK_WORDS + BLOCK_STEP), BLOCK_STEP):
        block = set(words[start : start + BLOCK_WORDS])
        for number, (_, template) in enumerate(TEMPLATES):
            tokens = set(template.split())
            if len(tokens & block) >= required(len(tokens)):
                found.add((number, start, len(tokens & block) / len(tokens)))
    return found


def test_query_equals_brute_force(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = op4_license_scan(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for row in rows:
        text = texts[row["doc_id"]]
        base = slow_base(text)
        assert tuple(row)[1:6] == base
        matches = slow_matches(text)
        labels = {TEMPLATES[n][0] for n, _, _ in matches} | set(filter(None, base[4].split(",")))
        assert row["labels"] == ",".join(sorted(labels))
        assert row["score"] == (1.0 if base[1] else max((c for *_, c in matches), default=0.0))


def test_the_join_finds_every_block_over_the_threshold(spark, make_docs):
    rng = random.Random(4)
    filler = "the of and to a in is it software license use public notice copy any".split()
    texts = []
    for i in range(300):
        words = rng.choices(filler, k=rng.randrange(0, 250))
        own = rng.choice(TEMPLATES)[1].split()
        kept = [w for w in own if rng.random() > 0.15]
        at = rng.randrange(len(words) + 1)
        texts.append(" ".join(words[:at] + kept + words[at:]))
    _, matches = scan(make_docs(texts))
    got = {}
    for row in matches.collect():
        key = (row["template"], row["first_word"], row["containment"])
        assert key not in got.setdefault(row["doc_id"], set())
        got[row["doc_id"]].add(key)
    for i, text in enumerate(texts):
        assert got.get(i, set()) == slow_matches(text)


def test_words():
    for _, text in ODD:
        if len(text or "") < 50_000:
            assert [w.decode() for w in words_of(text)] == slow_words(text)


def test_odd_rows(spark, make_docs):
    rows = label_documents(*scan(make_docs(ODD))).collect()
    assert len(rows) == len(ODD)
    row = next(r for r in rows if r["doc_id"] == 5)
    assert tuple(row)[:6] == (5, 6, 2, 1, 4, "mit")
    empty = next(r for r in rows if r["doc_id"] == 1)
    assert tuple(empty) == (1, 0, 0, None, None, "", "", 0.0)
    assert label_documents(*scan(make_docs([]))).count() == 0


def test_a_license_gets_no_other_licenses_label(spark, make_docs):
    notice = (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General "
        "Public License as published by the Free Software Foundation"
    )
    cases = [
        ("Licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
        ("Licensed under the GNU General Public License version 2", "gpl,gpl-2.0"),
        ("Licensed under the GNU Lesser General Public License version 3", ""),
        ("Licensed under CC BY-NC 4.0", "cc-by,cc-by-nc-4.0"),
        ("Licensed under CC BY-SA 4.0", "cc-by,cc-by-sa-4.0"),
        ("Licensed under CC BY-NC-SA 4.0", "cc-by"),
        ("Released under the Apache License", "apache"),
        ("Licensed under the terms of the Apache License, Version 2.0", "apache,apache-2.0"),
        ("Released under the MIT License", "mit,mit-notice"),
        ("released in MIT " + "some words " * 12 + "under a license of the house", ""),
        (notice.format(""), "gpl"),
        (notice.format("Affero "), "agpl"),
        (notice.format("Lesser "), "lgpl"),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ""),
    ]
    around = "here is some prose " * 20
    docs = make_docs([around + text + " and " + around for text, _ in cases])
    got = {r["doc_id"]: r["labels"] for r in label_documents(*scan(docs)).collect()}
    assert [got[i] for i in range(len(cases))] == [labels for _, labels in cases]


def test_templates_longer_than_a_block_are_found(spark, make_docs):
    rng = random.Random(9)
    full = [f"term{i}" for i in range(300)]
    texts = []
    for i in range(40):
        words = [f"other{rng.randrange(900)}" for _ in range(rng.randrange(900))]
        at = rng.randrange(len(words) + 1)
        texts.append(" ".join(words[:at] + (full if i % 2 else full[:200]) + words[at:]))
    templates = [*TEMPLATES, ("whole", " ".join(full))]
    _, matches = scan(make_docs(texts), templates=templates)
    found = matches.where("label = 'whole' and containment = 1 and confirmed").select("doc_id").distinct().collect()
    assert {r["doc_id"] for r in found} == set(range(1, 40, 2))
    assert matches.where("doc_id % 2 = 0").count() == 0
