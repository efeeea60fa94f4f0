"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of WINDOW words, a new one every STEP. Their TF-IDF vectors over
the benchmark's words form a matrix A that is never built: one pass over the corpus
adds up document frequencies and the sketch A'(A W) for a random W, partly in the
tasks and then in Spark. From the sketch follow A's leading singular values and
right vectors (randomised, single pass). Passages and benchmark items are folded into
that space and compared by cosine; what comes near is a candidate only. An item longer
than a window is compared by overlapping windows of its own, any of which makes it a
candidate, so the length of an item does not dilute it. A candidate
counts if the item's words come back in order in the text around the passage, which
their longest common subsequence measures: at least SAME of the item's words, or at
least PARAPHRASE of them together with the item's answer, its last sentence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame, functions as F

from passagelake.llm.common import map_rows

STEP = 16
WINDOW_STEPS = 3
WINDOW = STEP * WINDOW_STEPS
RANK = 80
SKETCH = 96
#: Of a window filled by the item; an item that fills the share f of it needs sqrt(f) of this.
MIN_COSINE = 0.5
SAME = 0.8
PARAPHRASE = 0.6
ANSWER = 0.75
#: Words from one window of a long item to the next.
ITEM_STEP = WINDOW // 2
#: Windows of items in a block, but for a single longer item.
ITEMS_AT_ONCE = 2048
#: Cosines that a task holds at once.
COSINES = 8192 * 2048
#: Words of regions that a task looks at in one go, but for a single longer region.
REGION_WORDS = 1 << 18
#: Rows that a task gathers at once, small enough for the processor's cache.
GATHERED = 4096
SEED = 20

# ASCII characters that are no letter or digit separate words; the bytes of others are kept.
_SEPARATORS = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words in UTF-8, cut at ASCII characters that are no letter or digit."""
    return (text or "").lower().encode().translate(_SEPARATORS).split()


def answer_of(text: str | None) -> list[bytes]:
    """Words of the last sentence with at least three words, else of the whole text."""
    for sentence in reversed(re.split(r"[.!?\n]+", text or "")):
        if len(found := words_of(sentence)) >= 3:
            return found
    return words_of(text)


def item_windows(size: int) -> list[tuple[int, int]]:
    """(first word, end) of the windows of an item of ``size`` words; the last ends with the item."""
    last = max(0, size - WINDOW)
    return [(at, min(size, at + WINDOW)) for at in [*range(0, last, ITEM_STEP), last]]


def common_subsequence(words: list[bytes], other: list[bytes]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``words``."""
    masks: dict[bytes, int] = {}
    for place, word in enumerate(words):
        masks[word] = masks.get(word, 0) | 1 << place
    full = (1 << len(words)) - 1
    row = full
    for word in other:
        if mask := masks.get(word):
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
    return len(words) - row.bit_count()


@dataclass
class Items:
    """A block of benchmark items, its vocabulary and bags of words."""

    ids: list
    words: list[list[bytes]]
    answers: list[list[bytes]]

    def __post_init__(self):
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for ws in self.words for w in ws}))}
        self.random = np.random.default_rng(SEED).standard_normal((len(self.vocabulary), SKETCH)).astype(np.float32)

    def contained(self, item: int, region: list[bytes]) -> float:
        """How much of an item stands in the region; 0 if it is not contaminated by it."""
        words = self.words[item]
        share = common_subsequence(words, region) / len(words)
        if share >= SAME:
            return share
        if share >= PARAPHRASE:
            answer = self.answers[item]
            if common_subsequence(answer, region) >= ANSWER * len(answer):
                return share
        return 0.0


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Items]:
    """The benchmark in blocks of ITEMS_AT_ONCE windows, in order of id; items without words are left out."""
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null")
    held: list = []
    windows = 0

    def block():
        return Items([r["i"] for r, _ in held], [w for _, w in held], [answer_of(r["t"]) for r, _ in held])

    for row in rows.orderBy("i", "t").toLocalIterator():
        if words := words_of(row["t"]):
            held.append((row, words))
            windows += len(item_windows(len(words)))
        if windows >= ITEMS_AT_ONCE:
            yield block()
            held, windows = [], 0
    if held:
        yield block()


def group_sums(vectors: np.ndarray, index: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``vectors[index]`` over the groups that begin at ``starts``, some groups at a time."""
    out = np.empty((len(starts), vectors.shape[1]), dtype=np.float32)
    edges = np.append(starts, len(index))
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(edges, edges[at] + GATHERED, side="right")) - 1)
        rows = vectors.take(index[edges[at] : edges[end]], axis=0)
        np.add.reduceat(rows, edges[at:end] - edges[at], axis=0, out=out[at:end])
        at = end
    return out


class Passages:
    """Words of a batch of texts as numbers, cut into steps that do not cross texts."""

    def __init__(self, texts: list[str | None], vocabulary: dict[bytes, int]):
        self.words = [words_of(t) for t in texts]
        lengths = np.array([len(ws) for ws in self.words], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(-(-lengths // STEP))])
        self.steps = int(self.first[-1])
        found = list(map(vocabulary.get, chain.from_iterable(self.words), repeat(-1)))
        code = np.array(found, dtype=np.int32)
        #: The number of every word, -1 for one that is not known, and where each text begins.
        self.every, self.begin, self.lengths = code, np.cumsum(lengths) - lengths, lengths
        # The word's place in its text, then the step it is in.
        place = np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        step = place // STEP + np.repeat(self.first[:-1], lengths)
        known = np.flatnonzero(code >= 0)
        self.code, self.step = code[known], step[known]

    def sums(self, vectors: np.ndarray) -> np.ndarray:
        """Sum of the word vectors in each step: (steps, width). Words come in order of the steps."""
        out = np.zeros((self.steps, vectors.shape[1]), dtype=np.float32)
        if len(self.code):
            starts = np.flatnonzero(np.diff(self.step, prepend=-1))
            out[self.step[starts]] = group_sums(vectors, self.code, starts)
        return out

    def spread(self, vectors: np.ndarray, size: int) -> np.ndarray:
        """The transpose: for each word the sum of its steps' vectors: (size, width)."""
        out = np.zeros((size, vectors.shape[1]), dtype=np.float64)
        if len(self.code):
            small = self.code.astype(np.uint16) if size < 1 << 16 else self.code
            order = np.argsort(small, kind="stable")
            code = self.code[order]
            starts = np.flatnonzero(np.diff(code, prepend=-1))
            out[code[starts]] = group_sums(vectors, self.step[order], starts)
        return out


def sketch(docs: DataFrame, items: Items) -> tuple[np.ndarray, np.ndarray, int]:
    """(document frequencies, T'(T W), number of passages) over all steps of all texts, T the counts.

    Each task adds up a matrix of (words of the items, SKETCH), whose size the block
    of items bounds; Spark adds up the rows of the tasks.
    """
    vocabulary, random = items.vocabulary, items.random
    size = len(vocabulary)

    def run(slices):
        total = np.zeros((size, SKETCH))
        frequency = np.zeros(size, dtype=np.int64)
        steps = 0
        for rows in slices:
            passages = Passages(rows["text"], vocabulary)
            total += passages.spread(passages.sums(random), size)
            pairs = np.unique(passages.step * size + passages.code)
            frequency += np.bincount(pairs % size, minlength=size)
            steps += passages.steps
        if steps:
            seen = np.flatnonzero(frequency)
            yield {
                "word": [-1, *seen.tolist()],
                "n": [steps, *frequency[seen].tolist()],
                "sums": [[0.0] * SKETCH, *total[seen].tolist()],
            }

    partial = map_rows(docs.select("text"), run, "word int, n bigint, sums array<double>")
    added = partial.groupBy("word").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(SKETCH)]
    )
    frequency, product, steps = np.zeros(size, dtype=np.int64), np.zeros((size, SKETCH)), 0
    for row in added.toLocalIterator():
        if row[0] < 0:
            steps = row[1]
        else:
            frequency[row[0]], product[row[0]] = row[1], row[2:]
    return frequency, product, steps


def latent_space(frequency: np.ndarray, product: np.ndarray, steps: int, random: np.ndarray) -> np.ndarray:
    """Word vectors (words, rank): IDF times right singular vectors over singular values.

    With D the IDF weights, A = T D. The sketch of A'A for the test matrix D^-1 W is
    D T'T W, so counts and frequencies come out of one pass. Nystrom's formula
    turns the sketch into eigenvectors of A'A.
    """
    weight = np.log((1 + steps) / (1 + frequency)) + 0.1
    seen = frequency > 0
    y = (product * weight[:, None])[seen]
    test = (random / weight[:, None])[seen]
    if not len(y):
        return np.zeros((len(frequency), 1), dtype=np.float32)
    core = test.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > values.max() * 1e-9
    if not good.any():
        return np.zeros((len(frequency), 1), dtype=np.float32)
    half = y @ (vectors[:, good] / np.sqrt(values[good]))
    left, singular, _ = np.linalg.svd(half, full_matrices=False)
    rank = min(RANK, int((singular > singular[0] * 1e-6).sum()))
    space = np.zeros((len(frequency), rank), dtype=np.float32)
    space[seen] = left[:, :rank] / singular[:rank] * weight[seen][:, None]
    return space


def unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


class Retriever:
    """Finds the items of a block in batches of texts."""

    def __init__(self, items: Items, space: np.ndarray):
        self.items, self.space = items, space
        bags, owners = [], []
        self.codes = [np.array([items.vocabulary[w] for w in words]) for words in items.words]
        for item, codes in enumerate(self.codes):
            for start, end in item_windows(len(codes)):
                bags.append(codes[start:end])
                owners.append(item)
        #: The item of each query; a query is a window of an item.
        self.owners = np.array(owners)
        self.queries = unit(np.stack([space[b].sum(axis=0) for b in bags])).astype(np.float32)
        # An item shorter than a window leaves room for other words, which turn the window away.
        held = np.array([len(b) for b in bags]) / WINDOW
        self.least = (MIN_COSINE * np.sqrt(held)).astype(np.float32)

    def possible(self, passages: Passages, text: np.ndarray, item: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which candidates' regions have the words that a paraphrase needs, each as often as the item has it.

        The item's different words are bits, 64 at a time, and a region's bits are those of its words.
        """
        sizes = np.array([len(w) for w in self.items.words])
        around = sizes[item] + 2 * STEP
        low = passages.begin[text] + np.maximum(0, start - around)
        high = passages.begin[text] + np.minimum(passages.lengths[text], start + WINDOW + around)
        held = np.zeros(len(item), dtype=np.int64)
        bits = np.zeros(len(self.items.vocabulary) + 1, dtype=np.uint64)
        order = np.argsort(item, kind="stable")
        for same in np.split(order, np.flatnonzero(np.diff(item[order])) + 1) if len(order) else []:
            words, times = np.unique(self.codes[item[same[0]]], return_counts=True)
            edges = np.cumsum(high[same] - low[same])
            at = 0
            while at < len(same):
                done = int(edges[at - 1]) if at else 0
                end = max(at + 1, int(np.searchsorted(edges, done + REGION_WORDS, side="right")))
                some = same[at:end]
                lengths = high[some] - low[some]
                starts = np.cumsum(lengths) - lengths
                region = passages.every[np.repeat(low[some] - starts, lengths) + np.arange(int(lengths.sum()))]
                for first in range(0, len(words), 64):
                    part = words[first : first + 64]
                    bits[part] = np.uint64(1) << np.arange(len(part), dtype=np.uint64)
                    # A word that is not known, -1, is the last entry, which has no bit.
                    seen = np.bitwise_or.reduceat(bits[region], starts).astype("<u8")
                    bits[part] = 0
                    shown = np.unpackbits(seen.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    held[some] += shown[:, : len(part)] @ times[first : first + 64]
                at = end
        return held >= PARAPHRASE * sizes[item]

    def candidates(self, passages: Passages) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(steps, items, cosines) of the windows that start at a step and come near an item."""
        sums = passages.sums(self.space)
        windows = sums.copy()
        text = np.repeat(np.arange(len(passages.words)), np.diff(passages.first))
        for shift in range(1, WINDOW_STEPS):
            # Windows end with their text.
            windows[:-shift] += sums[shift:] * (text[shift:] == text[:-shift])[:, None]
        windows = unit(windows)
        found = []
        rows = max(1, COSINES // len(self.queries))
        for at in range(0, len(windows), rows):
            cosine = windows[at : at + rows] @ self.queries.T
            step, query = np.divmod(np.flatnonzero(cosine >= self.least), len(self.queries))
            own = cosine[step, query]
            # Of windows of a text that overlap, the nearest stands for its neighbours.
            before, after = np.maximum(step - 1, 0), np.minimum(step + 1, len(cosine) - 1)
            place = text[at : at + len(cosine)]
            kept = (before == step) | (place[before] != place[step]) | (own >= cosine[before, query])
            kept &= (after == step) | (place[after] != place[step]) | (own > cosine[after, query])
            step, query = step[kept], query[kept]
            found.append((step + at, self.owners[query], own[kept]))
        if not found:
            return np.empty(0, int), np.empty(0, int), np.empty(0)
        return tuple(np.concatenate(part) for part in zip(*found))

    def matches(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, float, int]]:
        """(text, item, share of the item found, cosine, first word of the window), best per text and item."""
        passages = Passages(texts, self.items.vocabulary)
        steps, items, cosines = self.candidates(passages)
        owner = np.searchsorted(passages.first, steps, side="right") - 1
        # The subsequence has no more words than the two have in common, each as often as in both.
        kept = self.possible(passages, owner, items, (steps - passages.first[owner]) * STEP)
        owner, items, steps, cosines = owner[kept], items[kept], steps[kept], cosines[kept]
        best: dict[tuple[int, int], tuple[float, float, int]] = {}
        bags: dict[int, Counter] = {}
        for text, item, step, cosine in zip(owner.tolist(), items.tolist(), steps.tolist(), cosines.tolist()):
            words = self.items.words[item]
            start = (step - int(passages.first[text])) * STEP
            around = len(words) + 2 * STEP
            region = passages.words[text][max(0, start - around) : start + WINDOW + around]
            bag = bags.get(item)
            if bag is None:
                bag = bags[item] = Counter(words)
            held = Counter(filter(bag.__contains__, region))
            if sum(min(n, bag[w]) for w, n in held.items()) < PARAPHRASE * len(words):
                continue
            share = self.items.contained(item, region)
            if share and share > best.get((text, item), (0.0,))[0]:
                best[text, item] = (share, cosine, start)
        for (text, item), values in sorted(best.items()):
            yield text, item, *values


def contaminations(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Rows (row_id, doc_id, item_id, overlap, cosine, first_word): items found in documents.

    ``row_id`` tells rows with equal ids apart (monotonically_increasing_id of
    ``docs``). Null and empty texts match nothing, an empty benchmark gives no rows.
    """
    kinds = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    schema = (
        f"row_id bigint, doc_id {kinds[0]}, item_id {kinds[1]}, overlap double, cosine double, first_word bigint"
    )
    narrow = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
    )
    result = docs.sparkSession.createDataFrame([], schema)
    for items in item_blocks(benchmark, item_col, item_text_col):
        frequency, product, steps = sketch(narrow, items)
        if not steps:
            break
        retriever = Retriever(items, latent_space(frequency, product, steps, items.random))
        result = result.unionByName(map_rows(narrow, _finder(retriever), schema))
    return result


def _finder(retriever: Retriever):
    def run(slices):
        for rows in slices:
            names = ("row_id", "doc_id", "item_id", "overlap", "cosine", "first_word")
            out: dict[str, list] = {n: [] for n in names}
            for text, item, share, cosine, start in retriever.matches(rows["text"]):
                values = (rows["row_id"][text], rows["doc_id"][text], retriever.items.ids[item], share, cosine, start)
                for name, value in zip(names, values):
                    out[name].append(value)
            yield out

    return run
