"""Language identification by cross-parsing entropy.

The labelled text of a language becomes a suffix automaton. A text is parsed
against it into phrases: the longest match that starts here, then on behind it.
Text of the language needs few, long phrases. The language whose number of phrases
per character is least, relative to what its own unseen text needs, wins.

Texts are lower-cased; letters stay, everything else becomes one space. They are
parsed whole as UTF-8, so every script has its symbols, in blocks of BLOCK bytes that
each start a new phrase, so many blocks advance together, a byte at a time, in array
operations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from passagelake.llm.common import crc32_remainder, map_rows
from passagelake.session import reliable

UNDETERMINED = "und"
BLOCK = 1024
#: The sample the automata are built from: at most so many labelled documents and
#: characters for each language. Every document is classified, whatever the sample.
SAMPLE_DOCS = 64
SAMPLE_CHARS = 24_000
#: So many times the wanted texts are expected under the threshold: too few are as good as impossible.
ROOM = 8


def letters_only(text: str | None) -> str:
    """Lower-case letters with single spaces between the words."""
    import re

    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    if all(map(str.isalpha, words)):
        return " ".join(words)
    # Numerals such as ½ and Ⅷ are no letters.
    return " ".join("".join(c if c.isalpha() else " " for c in " ".join(words)).split())


def suffix_automaton(symbols: np.ndarray, size: int) -> np.ndarray:
    """Transitions of the automaton of all substrings: (states, size), -1 for none. Root is 0."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for symbol in symbols.tolist():
        state = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at != -1 and symbol not in moves[at]:
            moves[at][symbol] = state
            at = link[at]
        if at == -1:
            link[state] = 0
        else:
            target = moves[at][symbol]
            if length[at] + 1 == length[target]:
                link[state] = target
            else:
                clone = len(moves)
                moves.append(dict(moves[target]))
                link.append(link[target])
                length.append(length[at] + 1)
                while at != -1 and moves[at].get(symbol) == target:
                    moves[at][symbol] = clone
                    at = link[at]
                link[target] = link[state] = clone
        last = state
    table = np.full((len(moves), size), -1, dtype=np.int32)
    for state, out in enumerate(moves):
        for symbol, target in out.items():
            table[state, symbol] = target
    return table


@dataclass
class Model:
    """Languages with their automata.

    ``codes`` has for each language the column of each symbol in its table, whose last
    column is for the symbols that the language lacks. Without, symbols are columns.
    """

    languages: list[str]
    codes: np.ndarray
    tables: list[np.ndarray]
    scales: np.ndarray

    @staticmethod
    def encode(text: str) -> np.ndarray:
        return np.frombuffer(text.encode(), dtype=np.uint8)

    def phrases(self, blocks: list[np.ndarray]) -> np.ndarray:
        """Phrases of each block against each automaton: (languages, blocks)."""
        counts = np.zeros((len(self.tables), len(blocks)), dtype=np.int32)
        if not blocks:
            return counts
        lengths = np.array([len(b) for b in blocks])
        order = np.argsort(-lengths, kind="stable")
        sorted_lengths = lengths[order]
        columns = np.zeros((int(sorted_lengths[0]), len(blocks)), dtype=np.uint8)
        for place, i in enumerate(order):
            columns[: lengths[i], place] = blocks[i]
        alive = len(blocks) - np.searchsorted(sorted_lengths[::-1], np.arange(len(columns)), side="right")
        for k, table in enumerate(self.tables):
            width, between = table.shape[1], len(table)
            # One more state, between phrases, that nothing leads on from.
            flat = np.append(table.ravel(), np.full(width, -1, table.dtype))
            # A symbol the language lacks is a phrase by itself: the next one starts behind it.
            root = np.where(table[0] < 0, between, table[0]).astype(table.dtype)
            own = self.codes[k][columns] if self.codes.ndim == 2 else columns
            state = np.full(len(blocks), between, dtype=np.int32)
            begun = np.zeros(len(blocks), dtype=np.int32)
            for at in range(len(columns)):
                n = alive[at]
                symbols = own[at, :n]
                step = flat.take(state[:n] * width + symbols)
                failed = step < 0
                # The phrase ends before this symbol, which starts the next one.
                begun[:n] += failed
                np.copyto(step, root[symbols], where=failed)
                state[:n] = step
            counts[k, order] = begun
        return counts

    def classify(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; ``und`` and 0 without a letter.

        The score is one less the ratio of the best to the second best normalised
        number of phrases (1 if only one language is known). Ties go to the first name.
        """
        blocks, owners, sizes = [], [], np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            symbols = self.encode(letters_only(text))
            sizes[i] = len(symbols)
            for at in range(0, len(symbols), BLOCK):
                blocks.append(symbols[at : at + BLOCK])
                owners.append(i)
        totals = np.zeros((len(self.tables), len(texts)))
        if blocks and self.tables:
            counted = self.phrases(blocks)
            for k in range(len(self.tables)):
                totals[k] = np.bincount(owners, weights=counted[k], minlength=len(texts))
        names, scores = [], []
        for i in range(len(texts)):
            if not sizes[i] or not self.tables:
                names.append(UNDETERMINED)
                scores.append(0.0)
                continue
            needed = totals[:, i] / self.scales
            best = int(needed.argmin())
            rest = np.delete(needed, best)
            names.append(self.languages[best])
            scores.append(1.0 if not len(rest) else float(1 - needed[best] / rest.min()))
        return names, scores


def build_model(samples: dict[str, list[str]], chars: int = SAMPLE_CHARS) -> Model:
    """Automata from the sample texts of each language.

    A fifth of a language's characters is kept back to measure how many phrases its
    own text needs; the measured rates are the scales that make languages comparable.
    """
    languages = sorted(samples)
    joined = {name: " ".join(letters_only(t) for t in samples[name])[:chars] for name in languages}
    model = Model(languages, np.zeros((len(languages), 256), dtype=np.uint8), [], np.ones(len(languages)))
    rates = []
    for k, name in enumerate(languages):
        symbols = model.encode(joined[name])
        edge = len(symbols) - len(symbols) // 5
        known = np.unique(symbols[:edge])
        model.codes[k] = len(known)
        model.codes[k, known] = np.arange(len(known))
        model.tables.append(suffix_automaton(model.codes[k][symbols[:edge]], len(known) + 1))
        held = symbols[edge:]
        blocks = [held[i : i + BLOCK] for i in range(0, len(held), BLOCK)]
        own = Model([name], model.codes[k : k + 1], model.tables[-1:], np.ones(1)).phrases(blocks).sum()
        rates.append(own / len(held) if len(held) else 0.0)
    known = [r for r in rates if r] or [1.0]
    model.scales = np.array([r or float(np.mean(known)) for r in rates])
    # A rate much unlike the others comes from too little text: do not trust it alone.
    middle = float(np.median(model.scales)) if rates else 1.0
    model.scales = np.clip(model.scales, middle / 1.25, middle * 1.25)
    return model


def sample_rows(labelled: DataFrame, docs_per_language: int = SAMPLE_DOCS) -> DataFrame:
    """At most ``docs_per_language`` different texts (lang, h, text) of each language, least hash first.

    The choice is made on hashes alone. Counts and chosen hashes are sent to all tasks:
    one and docs_per_language rows per label.
    """
    rows = labelled.where("text is not null and lang is not null").select(
        "lang", F.xxhash64("lang", "text").alias("h"), "text"
    )
    distinct = reliable(rows.select("lang", "h").distinct())
    # Hashes are uniform: a threshold a little above the wanted share leaves few to order.
    counts = distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("h") / float(1 << 64) + 0.5
    near = distinct.join(F.broadcast(counts), "lang").where(share < ROOM * docs_per_language / F.col("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = near.withColumn("place", place).where(F.col("place") <= docs_per_language).select("lang", "h")
    return rows.join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"])


def train(labelled: DataFrame, docs_per_language: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> Model:
    """Automata of the languages in (text, lang) rows; rows without text or label are left out."""
    cleaned = F.substring(F.lower("text"), 1, chars)
    rows = sample_rows(labelled.withColumn("text", cleaned), docs_per_language).collect()
    samples: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["h"])):
        samples.setdefault(row["lang"], []).append(row["text"])
    return build_model(samples, chars)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, lang_pred, score) of every whole text, in place: nothing is shuffled.

    ``und`` and 0 for null and empty texts, texts without a letter, and all texts if the
    model knows no language. Every row gives one, whether its id is null or repeats; other
    columns are not looked at. An empty table gives no rows.
    """

    def run(slices):
        for rows in slices:
            names, scores = model.classify(rows["text"])
            yield {"doc_id": rows["doc_id"], "lang_pred": names, "score": scores}

    kind = dict(docs.dtypes)[id_col]
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(narrow, run, f"doc_id {kind}, lang_pred string, score double")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where((crc32_remainder("doc_id", 4) != 2) & F.col("lang").isNotNull())
