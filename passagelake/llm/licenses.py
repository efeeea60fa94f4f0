"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a window of BLOCK_WORDS words, a new one every BLOCK_STEP, so every
passage of up to BLOCK_WORDS - BLOCK_STEP words lies whole in a block; longer templates
have blocks and steps that are 2, 4, 8 ... times as long. A block meets
a template if it contains at least THRESHOLD of the template's distinct words, or all
of them if they are fewer than SHORT. The
tokens of templates and blocks are ordered by their frequency in the whole corpus,
rarest first. To meet a template a block must hold one of its first
|T| - overlap + 1 tokens (prefix filter), enough template words at all (length
filter), and enough of them left behind the first common token (positional filter).
What passes is verified, so the join loses and adds nothing.

A match gives its label if it is confirmed too: the words of a short template stand close
together, and the phrases that tell the license from its relatives (MARKS) are there.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame, functions as F

from passagelake.llm.common import map_rows
from passagelake.session import reliable

THRESHOLD = 0.8
BLOCK_WORDS = 96
BLOCK_STEP = 48
#: Templates of fewer different words differ from others in one word: they are needed whole.
SHORT = 16

# The phrases of the base scan with their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Characteristic wordings of licenses, at most 48 words each.
TEMPLATES = [
    ("mit-notice", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("no-warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose"),
]

# Phrases that a block must hold for the label, in a template's close words if it is short.
MARKS = {
    "gpl": ["gnu general public license"],
    "gpl-2.0": ["gnu general public license", "version 2"],
    "gpl-3.0": ["gnu general public license", "version 3"],
    "cc-by-nc-4.0": ["by nc 4 0"],
    "cc-by-sa-4.0": ["by sa 4 0"],
    "cc-by-4.0": ["attribution 4 0"],
}

# Everything that is no ASCII letter or digit and no part of a longer code point separates words.
_SEPARATORS = bytes(
    32 if c < 128 and not chr(c).isalnum() else c for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words of the text: ASCII letters lower-cased, cut at ASCII characters that are no letter or digit."""
    return (text or "").encode().lower().translate(_SEPARATORS).split()


def required(size: int, threshold: float = THRESHOLD) -> int:
    """The least overlap that contains ``threshold`` of ``size`` tokens; all of fewer than SHORT."""
    if size < SHORT:
        return max(1, size)
    return max(1, math.ceil(threshold * size - 1e-9))


def template_tokens(templates=TEMPLATES) -> list[set[str]]:
    return [set(text.split()) for _, text in templates]


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Every word position at which the phrase's words stand one after the other."""
    found, at = [], -1
    try:
        while True:
            at = words.index(phrase[0], at + 1)
            if words[at : at + len(phrase)] == phrase:
                found.append(at)
    except ValueError:
        return found


def level_of(size: int) -> int:
    """Blocks and steps are 2 ** level times as long for a template of ``size`` words."""
    return max(0, math.ceil(math.log2(max(1, size) / BLOCK_STEP)))


def confirmed(block: list[bytes], template: list[bytes], marks: list[bytes]) -> bool:
    """Whether the marks (padded phrases) stand in the block: near the words of a template if it is short.

    The words of a short template must lie in a stretch of at most twice its length.
    """
    wanted = set(template)
    if len(wanted) >= SHORT:
        joined = b" " + b" ".join(block) + b" "
        return all(m in joined for m in marks)
    size = 2 * len(template)
    last: dict[bytes, int] = {}
    for at, word in enumerate(block):
        if word in wanted:
            last[word] = at
            if len(last) == len(wanted) and at - (first := min(last.values())) < size:
                joined = b" " + b" ".join(block[first : at + 1]) + b" "
                if all(m in joined for m in marks):
                    return True
    return False


def token_frequencies(docs: DataFrame, tokens: set[str], text_col: str = "text") -> dict[str, int]:
    """Documents of the whole corpus that hold each of the given (template) tokens."""
    wanted = {t.encode() for t in tokens}

    def run(slices):
        counts: Counter = Counter()
        for rows in slices:
            for text in rows["text"]:
                counts.update(wanted.intersection(words_of(text)))
        yield {"token": [t.decode() for t in counts], "n": list(counts.values())}

    counted = map_rows(docs.select(F.col(text_col).alias("text")), run, "token string, n bigint")
    rows = counted.groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {t: 0 for t in tokens} | {r["token"]: r["n"] for r in rows}


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates=TEMPLATES,
    threshold: float = THRESHOLD,
) -> tuple[DataFrame, DataFrame]:
    """(documents, matches) of a corpus.

    Documents: row_id, doc_id, n_words, n_base, first_word, last_word, base_labels (array).
    Matches: row_id, doc_id, template, label, first_word, n_words, containment, confirmed, one row for
    every block and template that meet the threshold.

    Null and empty texts have no words and match nothing. Rows with the same id stay
    apart through ``row_id``. Texts are scanned whole.
    """
    sets = template_tokens(templates)
    counts = token_frequencies(docs, set().union(*sets), text_col)
    order = {t: i for i, t in enumerate(sorted(counts, key=lambda t: (counts[t], t)))}
    known = {t.encode(): i for t, i in order.items()}
    spelled = [text.encode().split() for _, text in templates]
    levels = [level_of(len(ws)) for ws in spelled]
    marks = [[f" {m} ".encode() for m in MARKS.get(label, ())] for label, _ in templates]
    prefix_rows = []
    for number, tokens in enumerate(sets):
        ranks = sorted(order[t] for t in tokens)
        need = required(len(ranks), threshold)
        for place, token in enumerate(ranks[: len(ranks) - need + 1]):
            prefix_rows.append((token, number, place, len(ranks), need, ranks, levels[number]))
    by_level = []
    for level in sorted(set(levels)):
        rows = [r for r in prefix_rows if r[6] == level]
        firsts = {r[0] for r in rows}
        # Only these may meet the threshold and not be confirmed.
        doubtful = [
            (i, set(ws), required(len(set(ws)), threshold), ws, marks[i])
            for i, ws in enumerate(spelled)
            if levels[i] == level and (len(set(ws)) < SHORT or marks[i])
        ]
        rare = {t for t, i in known.items() if i in firsts}
        by_level.append((level, rare, min(r[4] for r in rows), doubtful))
    phrases = [(p.encode().split(), f" {p} ".encode(), label) for p, label in PHRASES]

    def run(slices):
        for rows in slices:
            out: dict[str, list] = {
                k: [] for k in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "blocks")
            }
            for at, text in zip(rows["doc_id"], rows["text"]):
                words = words_of(text)
                joined = b" " + b" ".join(words) + b" "
                starts, labels = [], set()
                for phrase, padded, label in phrases:
                    if padded in joined:
                        starts += places(words, phrase)
                        labels.add(label)
                blocks = []
                for level, rare, shortest, doubtful in by_level:
                    if rare.isdisjoint(words):
                        continue
                    size, step = BLOCK_WORDS << level, BLOCK_STEP << level
                    for start in range(0, max(1, len(words) - size + step), step):
                        spell = words[start : start + size]
                        block = set(spell)
                        if rare.isdisjoint(block):
                            continue
                        tokens = sorted(known[w] for w in block if w in known)
                        if len(tokens) >= shortest:
                            refused = [
                                number
                                for number, wanted, need, template, own in doubtful
                                if len(wanted & block) >= need and not confirmed(spell, template, own)
                            ]
                            blocks.append(
                                {"level": level, "first_word": start, "n_words": len(spell), "tokens": tokens, "refused": refused}
                            )
                out["doc_id"].append(at)
                out["n_words"].append(len(words))
                out["n_base"].append(len(starts))
                out["first_word"].append(min(starts, default=None))
                out["last_word"].append(max(starts, default=None))
                out["base_labels"].append(sorted(labels))
                out["blocks"].append(blocks)
            yield out

    kind = dict(docs.dtypes)[id_col]
    block = "array<struct<level: int, first_word: bigint, n_words: bigint, tokens: array<int>, refused: array<int>>>"
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scanned = map_rows(
        narrow,
        run,
        f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
        f"base_labels array<string>, blocks {block}",
    )
    scanned = reliable(scanned.withColumn("row_id", F.monotonically_increasing_id()))
    prefixes = docs.sparkSession.createDataFrame(
        prefix_rows, "token int, template int, place int, size int, need int, ranks array<int>, level int"
    )
    names = F.create_map(*[F.lit(x) for i, (label, _) in enumerate(templates) for x in (i, label)])
    blocks = scanned.select("row_id", "doc_id", F.explode("blocks").alias("b")).select("row_id", "doc_id", "b.*")
    tokens = blocks.select("*", F.posexplode("tokens").alias("at", "token"))
    # The templates are constants of the program: a few hundred prefix rows.
    candidates = tokens.join(F.broadcast(prefixes), ["token", "level"]).where(
        (F.size("tokens") >= F.col("need"))
        & (F.least(F.size("tokens") - F.col("at"), F.col("size") - F.col("place")) >= F.col("need"))
    )
    shared = F.size(F.array_intersect("tokens", "ranks"))
    first_common = F.array_intersect("tokens", "ranks")[0] == F.col("token")
    matches = candidates.where((shared >= F.col("need")) & first_common).select(
        "row_id",
        "doc_id",
        "template",
        names[F.col("template")].alias("label"),
        "first_word",
        "n_words",
        (shared / F.col("size")).alias("containment"),
        (~F.array_contains("refused", F.col("template"))).alias("confirmed"),
    )
    return scanned.drop("blocks"), matches


def label_documents(documents: DataFrame, matches: DataFrame) -> DataFrame:
    """One row per document: base columns, ``labels`` of both ways, ``score``.

    Only confirmed matches count. The score is 1 with a base phrase, else the best
    containment (0 without a match).
    """
    best = matches.where("confirmed").groupBy("row_id").agg(
        F.collect_set("label").alias("found"), F.max("containment").alias("best")
    )
    joined = documents.join(best, "row_id", "left")
    all_labels = F.array_sort(
        F.array_union("base_labels", F.coalesce("found", F.array().cast("array<string>")))
    )
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(all_labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
