"""Language-model scores: a probabilistic suffix tree over the bytes of the tokens.

A text is a sequence of tokens: its words, lower-cased (A-Z), and one end. It is
spelled as bytes, the words parted by a space and closed by a line feed, which no
word contains; so a probability of the spelling is one of the token sequence.

Spark counts, over all training texts, each byte with the DEPTH bytes before it, and
from these the shorter ones, length by length. A context (the last 0 to DEPTH bytes) is
kept if it was seen at least LEAST_SEEN times and its next-byte counts diverge from those
of the context one byte shorter by GAIN nats or more; suffixes of a kept one are kept too.
Both limits are absolute: a larger corpus keeps more contexts. Next-byte distributions are
smoothed with the shorter context's. A byte's probability is that in the longest kept
suffix of the bytes before it.

The tree is a table. Its part for a group of contexts has a bounded size and is sent to the
tasks; texts are read once for each part, and their scores' parts are added up.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import log10

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from passagelake.llm.common import crc32_remainder, map_rows
from passagelake.session import reliable

DEPTH = 5
LEAST_SEEN = 8
GAIN = 12.0
END_WORD = "\n"
#: Bytes of text whose windows are held at once.
WINDOW_BYTES = 1 << 20
#: Words that make at least this share of the training tokens, a million at most, are
#: sent to all tasks with their counts; the others are joined.
COMMON_SHARE = 1e-6
HELD_WORDS = 150_000
HELD_GRAMS = 1_500_000
#: Next bytes of contexts that are sent to the tasks at once, about.
PART_ENTRIES = 6_000_000
#: The probability of a byte that nothing is known of.
UNKNOWN = 1 / 256


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def spelled(words: list[bytes]) -> bytes:
    return b" ".join(words) + b"\n"


def windows(streams: list[bytes]):
    """(owners, keys): every byte of the streams with the DEPTH bytes before it, as numbers.

    In pieces of about WINDOW_BYTES; a stream begins behind line feeds.
    """
    blocks, owners, held = [], [], 0
    for owner, stream in enumerate(streams):
        data = b"\n" * DEPTH + stream
        for at in range(0, len(stream), WINDOW_BYTES):
            blocks.append(data[at : at + WINDOW_BYTES + DEPTH])
            owners.append(owner)
            held += len(blocks[-1])
            if held >= WINDOW_BYTES:
                yield _windows(blocks, owners)
                blocks, owners, held = [], [], 0
    if blocks:
        yield _windows(blocks, owners)


def _windows(blocks: list[bytes], owners: list[int]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(blocks), np.uint8)
    key = np.zeros(len(data) - DEPTH, np.int64)
    for at in range(DEPTH + 1):
        key <<= 8
        key |= data[at : at + len(key)]
    # What begins in one block and ends in the next is no window.
    lengths = np.array([len(b) for b in blocks])
    own = np.ones(len(data), dtype=bool)
    ends = np.cumsum(lengths)
    for back in range(1, DEPTH + 1):
        own[ends - back] = False
    return np.repeat(owners, lengths - DEPTH), key[own[: len(key)]]


def count_corpus(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Counts over all rows: (word, n) of tokens and (gram, n) of windows, in one table.

    Tasks count their own rows first. The end token is the word END_WORD.
    """

    def run(slices):
        words: Counter = Counter()
        grams, counts = [], []

        def word_rows():
            out = {"word": [w.decode() for w in words], "n": list(words.values())}
            return out | {"gram": [None] * len(words)}

        def gram_rows():
            keys, group = np.unique(np.concatenate(grams), return_inverse=True)
            n = np.bincount(group, weights=np.concatenate(counts)).astype(np.int64)
            return keys, n

        def gram_out(keys, n):
            return {"word": [None] * len(keys), "gram": keys, "n": n}

        held = 0
        for rows in slices:
            streams = []
            for text in rows["text"]:
                own = tokens(text)
                words.update(own)
                streams.append(spelled(own))
            words[b"\n"] += len(streams)
            for _, keys in windows(streams):
                key, n = np.unique(keys, return_counts=True)
                grams.append(key)
                counts.append(n)
                held += len(key)
            if held >= HELD_GRAMS:
                key, n = gram_rows()
                grams, counts, held = [key], [n], len(key)
                if held >= HELD_GRAMS // 2:
                    yield gram_out(key, n)
                    grams, counts, held = [], [], 0
            if len(words) >= HELD_WORDS:
                yield word_rows()
                words.clear()
        if words:
            yield word_rows()
        if grams:
            yield gram_out(*gram_rows())

    partial = map_rows(docs.select(F.col(text_col).alias("text")), run, "word string, gram bigint, n bigint")
    return partial.groupBy("word", "gram").agg(F.sum("n").alias("n"))


def _low(column: str, size: int) -> Column:
    """The last ``size`` bytes of a number."""
    return F.col(column).bitwiseAND(F.lit((1 << 8 * size) - 1))


def levels(grams: DataFrame) -> list[DataFrame]:
    """For each length of context: (gram, context, n, total, ways).

    A gram is a context and the byte behind it. ``total`` counts the context, ``ways`` the
    different bytes behind it: a context has 256 rows at most.
    """
    out: list[DataFrame] = []
    counts = grams
    for depth in range(DEPTH, -1, -1):
        if depth < DEPTH:
            counts = out[0].groupBy(_low("gram", depth + 1).alias("gram")).agg(F.sum("n").alias("n"))
        own = Window.partitionBy("context")
        level = counts.withColumn("context", F.shiftrightunsigned("gram", 8)).withColumns(
            {"total": F.sum("n").over(own), "ways": F.count(F.lit(1)).over(own)}
        )
        out.insert(0, reliable(level.select("gram", "context", "n", "total", "ways")))
    return out


def divergences(longer: DataFrame, shorter: DataFrame, depth: int, least: int = LEAST_SEEN) -> DataFrame:
    """(context, gain) of the contexts of a length that were seen often enough.

    ``gain`` is the total times the Kullback-Leibler divergence (nats) of the next
    byte given the context from the next byte given the context one byte shorter.
    """
    before = shorter.select(F.col("gram").alias("suffix"), (F.col("n") / F.col("total")).alias("share"))
    ratio = F.col("n") / F.col("total") / F.col("share")
    rows = longer.where(F.col("total") >= least).withColumn("suffix", _low("gram", depth))
    return rows.join(before, "suffix").groupBy("context").agg(F.sum(F.col("n") * F.ln(ratio)).alias("gain"))


@dataclass
class Tree:
    """The kept contexts as tables.

    ``entries`` (depth, gram, p): the probability of a byte seen behind a context;
    ``contexts`` (depth, context, back): what an unseen byte's probability in the context one
    byte shorter is multiplied with.
    """

    entries: DataFrame
    contexts: DataFrame


def grow_tree(grams: DataFrame, least: int = LEAST_SEEN, gain: float = GAIN) -> Tree:
    """Keep the diverging contexts and their suffixes, and smooth from the shortest on."""
    counted = levels(grams)
    kept: dict[int, DataFrame] = {}
    for depth in range(DEPTH, 0, -1):
        found = divergences(counted[depth], counted[depth - 1], depth, least).where(F.col("gain") >= gain)
        found = found.select("context")
        if depth < DEPTH:
            found = found.unionByName(kept[depth + 1].select(_low("context", depth).alias("context"))).distinct()
        kept[depth] = reliable(found)
    entries = contexts = before = None
    for depth in range(DEPTH + 1):
        rows = counted[depth]
        if depth:
            rows = rows.join(kept[depth], "context", "left_semi").withColumn("suffix", _low("gram", depth))
            rows = rows.join(before.select(F.col("gram").alias("suffix"), F.col("p").alias("less")), "suffix")
            weight, less = F.col("ways"), F.col("less")
        else:
            weight, less = F.lit(1), F.lit(UNKNOWN)
        total = F.col("total") + weight
        p = ((F.col("n") + weight * less) / total).alias("p")
        before = reliable(rows.select("gram", "context", p, (weight / total).alias("back")))
        level = F.lit(depth).alias("depth")
        own = before.select(level, "gram", "p")
        held = before.groupBy("context").agg(F.first("back").alias("back")).select(level, "context", "back")
        entries = own if entries is None else entries.unionByName(own)
        contexts = held if contexts is None else contexts.unionByName(held)
    return Tree(entries, reliable(contexts))


#: Contexts fall into parts by their last two bytes; shorter ones are in every part.
PART_STEP = 40_503


def _part(last: Column | np.ndarray, parts: int):
    if isinstance(last, Column):
        return F.pmod((last * PART_STEP).bitwiseAND(F.lit(0xFFFF)), F.lit(parts))
    return (last * PART_STEP & 0xFFFF) % parts


class Suffixes:
    """A part of the tree in a task: probabilities of windows by the longest kept suffix."""

    def __init__(self, contexts: np.ndarray, backs: np.ndarray, entries: np.ndarray, logs: np.ndarray):
        self.contexts, self.backs, self.entries, self.logs = contexts, backs, entries, logs

    @staticmethod
    def collected(tree: Tree, part: int, parts: int) -> Suffixes:
        def arrays(rows: DataFrame, key: str, last: Column, value: str):
            short = F.col("depth") < 2
            own = rows.where(short | (_part(last.bitwiseAND(F.lit(0xFFFF)), parts) == part))
            number = F.call_function("shiftleft", F.col("depth").cast("bigint"), F.lit(48)).bitwiseOR(F.col(key))
            table = own.select(number.alias("key"), F.log10(value).alias("log")).toArrow()
            keys = table["key"].to_numpy()
            order = np.argsort(keys)
            return keys[order], table["log"].to_numpy()[order].astype(np.float32)

        contexts = arrays(tree.contexts, "context", F.col("context"), "back")
        return Suffixes(*contexts, *arrays(tree.entries, "gram", F.shiftrightunsigned("gram", 8), "p"))

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return place, keys[place] == wanted

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """The logarithm of each window's last byte's probability."""
        out = np.zeros(len(grams))
        open_ = np.arange(len(grams))
        for depth in range(DEPTH, -1, -1):
            gram = grams[open_] & ((1 << 8 * (depth + 1)) - 1)
            place, kept = self._find(self.contexts, gram >> 8 | depth << 48)
            at = open_[kept]
            entry, seen = self._find(self.entries, gram[kept] | depth << 48)
            out[at[seen]] += self.logs[entry[seen]]
            out[at[~seen]] += self.backs[place[kept][~seen]]
            done = np.zeros(len(open_), dtype=bool)
            done[np.flatnonzero(kept)[seen]] = True
            open_ = open_[~done]
        out[open_] += log10(UNKNOWN)
        return out

    def scores(self, streams: list[bytes], part: int = 0, parts: int = 1) -> np.ndarray:
        """The sum of each stream's logarithms, over the windows that belong to a part."""
        total = np.zeros(len(streams))
        for owners, keys in windows(streams):
            if parts > 1:
                own = _part(keys >> 8 & 0xFFFF, parts) == part
                owners, keys = owners[own], keys[own]
            different, place = np.unique(keys, return_inverse=True)
            total += np.bincount(owners, weights=self.log10(different)[place], minlength=len(streams))
        return total


def score(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``base_score`` is the smoothed unigram score over words, ``score`` the tree's;
    both are log10 probabilities. A null or empty text is the end alone. Rows with
    the same id each get a row. Without training rows every word is unknown, and all
    bytes are equally likely. Other columns are not looked at.
    """
    counted = reliable(count_corpus(training, text_col))
    words = counted.where("word is not null").select("word", "n")
    totals = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    all_tokens, distinct = totals["n"] or 0, totals["v"]
    tree = grow_tree(counted.where("gram is not null").select("gram", "n"))
    parts = max(1, -(-tree.entries.count() // PART_ENTRIES))
    least = max(1, int(all_tokens * COMMON_SHARE))
    common = {r["word"].encode(): r["n"] for r in words.where(F.col("n") >= least).collect()}
    logs = {w: float(np.log10(n + 0.1)) for w, n in common.items()}
    # Every text has an end, however small its share of the tokens.
    ends = words.where(F.col("word") == END_WORD).first()
    known_end, end_log = int(ends is not None), float(np.log10((ends["n"] if ends else 0) + 0.1))
    logs.pop(END_WORD.encode(), None)
    share = float(np.log10(all_tokens + 0.1 * (distinct + 1))) if all_tokens else float(np.log10(0.1))

    def run(slices):
        import xxhash

        for rows in slices:
            out: dict[str, list] = {k: [] for k in ("n_tokens", "n_common", "common_log", "rare", "times")}
            streams = []
            for text in rows["text"]:
                own = tokens(text)
                streams.append(spelled(own))
                known, total, rare, times = known_end, end_log, [], []
                for word, n in Counter(own).items():
                    log = logs.get(word)
                    if log is None:
                        rare.append(word)
                        times.append(n)
                    else:
                        known += n
                        total += n * log
                hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in rare], np.uint64)
                out["n_tokens"].append(len(own) + 1)
                out["n_common"].append(known)
                out["common_log"].append(total)
                out["rare"].append(hashes.view(np.int64))
                out["times"].append(times)
            yield out | {"row_id": rows["row_id"], "doc_id": rows["doc_id"], "score": first.value.scores(streams, 0, parts)}

    def later(part):
        sent = narrow.sparkSession.sparkContext.broadcast(Suffixes.collected(tree, part, parts))

        def run(slices):
            for rows in slices:
                found = sent.value.scores([spelled(tokens(t)) for t in rows["text"]], part, parts)
                yield {"row_id": rows["row_id"], "score": found}

        return map_rows(narrow.select("row_id", "text"), run, "row_id bigint, score double")

    kind = dict(docs.dtypes)[id_col]
    narrow = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")
    )
    if parts > 1:
        # The rows are read once for each part and must have the same numbers.
        narrow = reliable(narrow)
    first = narrow.sparkSession.sparkContext.broadcast(Suffixes.collected(tree, 0, parts))
    scored = reliable(
        map_rows(
            narrow,
            run,
            f"row_id bigint, doc_id {kind}, n_tokens bigint, n_common bigint, common_log double, "
            "rare array<bigint>, times array<int>, score double",
        )
    )
    by_row = scored.select("row_id", "score")
    for part in range(1, parts):
        by_row = reliable(by_row.unionByName(later(part)).groupBy("row_id").agg(F.sum("score").alias("score")))
    # Words are joined by their 64-bit hash, the same in both functions.
    rare = scored.select("row_id", F.explode(F.arrays_zip("rare", "times")).alias("w")).select(
        "row_id", F.col("w.rare").alias("h"), F.col("w.times").alias("times")
    )
    counts = words.where(F.col("n") < least).select(F.xxhash64("word").alias("h"), "n")
    times, n = F.col("times"), F.coalesce("n", F.lit(0))
    looked_up = rare.join(counts, "h", "left").groupBy("row_id").agg(
        F.sum(F.when(n > 0, times).otherwise(0)).alias("rare_known"),
        F.sum(times * F.log10(n + 0.1)).alias("rare_log"),
    )
    if parts > 1:
        scored = scored.drop("score").join(by_row, "row_id")
    return scored.drop("rare", "times").join(looked_up, "row_id", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_common") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(all_tokens).cast("bigint").alias("train_tokens"),
        (F.col("common_log") + F.coalesce("rare_log", F.lit(0.0)) - F.col("n_tokens") * F.lit(share)).alias(
            "base_score"
        ),
        "score",
    )


def held_out(column: str = "doc_id"):
    return crc32_remainder(column, 10) == 0
