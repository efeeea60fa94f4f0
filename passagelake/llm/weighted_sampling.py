"""Document fingerprints by consistent weighted sampling.

A document is a set of words with weights (how often each stands in it). For each
of K samples and each word, two Gamma(2, 1) numbers and one uniform number are
drawn from the word's hash; they give the word a quantised weight and a rank, and
the word of least rank is the sample. Two documents draw the same (word, quantised
weight) with the probability of their generalised Jaccard similarity
sum(min) / sum(max), so the share of equal samples estimates it.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from passagelake.llm.common import map_rows
from passagelake.session import reliable

#: Rows of one id are dealt by so many characters of the text, which do not contradict its order.
DEALT_CHARS = 64

SAMPLES = 128
BLOCK_WORDS = 4096
#: Words whose numbers are drawn at once, few enough for the processor's cache.
DRAWN_WORDS = 256
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: uniform 64-bit numbers from counters."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _draws(hashes: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and beta for every word (row) and sample (column), as float32."""
    steps = np.arange(1, 3 * samples + 1, dtype=np.uint64) * GOLDEN
    bits = _mix(hashes[:, None] + steps[None, :])
    unit = np.float32(2.0**-32)
    high = ((bits >> np.uint64(32)).astype(np.float32) + np.float32(0.5)) * unit
    low = ((bits & np.uint64(0xFFFFFFFF)).astype(np.float32) + np.float32(0.5)) * unit
    first, second, third = (slice(i * samples, (i + 1) * samples) for i in range(3))
    # Rounding may give exactly 1; the logarithm must stay below zero.
    below_one = np.float32(1 - 2.0**-24)
    r = -np.log(np.minimum(high[:, first] * low[:, first], below_one))
    c = -np.log(np.minimum(high[:, second] * low[:, second], below_one))
    beta = np.minimum(high[:, third], below_one)
    return r, np.log(c), beta


class Sampler:
    """Signatures of batches of texts; draws are made once per batch and distinct word."""

    def __init__(self, samples: int = SAMPLES):
        self.samples = samples

    def signatures(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """A row of ``samples`` 16-bit numbers per text; None for a text without words."""
        import xxhash

        # A word that is new gets the next number.
        vocabulary: defaultdict[str, int] = defaultdict()
        vocabulary.default_factory = vocabulary.__len__
        bags = []
        for text in texts:
            words = (text or "").lower().split()
            ids = np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words))
            bags.append(np.unique(ids, return_counts=True))
        hashes = np.fromiter(
            map(xxhash.xxh64_intdigest, vocabulary), np.uint64, len(vocabulary)
        )
        plain = np.empty((len(hashes), self.samples), np.float32)
        r = np.empty_like(plain)
        log_c = np.empty_like(plain)
        beta = np.empty_like(plain)
        for at in range(0, len(hashes), DRAWN_WORDS):
            part = slice(at, at + DRAWN_WORDS)
            r[part], log_c[part], beta[part] = _draws(hashes[part], self.samples)
            # A word that stands once has quantised weight 0: its rank needs no count.
            plain[part] = log_c[part] - r[part] * (1 - beta[part])
        return [self._least(hashes, plain, r, log_c, beta, *bag) for bag in bags]

    def _least(self, hashes, plain, r, log_c, beta, ids, counts) -> np.ndarray | None:
        if not len(ids):
            return None
        columns = np.arange(self.samples)
        best = np.full(self.samples, np.inf, np.float32)
        word = np.zeros(self.samples, np.uint64)
        level = np.zeros(self.samples, np.int64)
        single = ids[counts == 1]
        for at in range(0, len(single), BLOCK_WORDS):
            some = single[at : at + BLOCK_WORDS]
            ranks = plain[some]
            least = ranks.argmin(axis=0)
            value = ranks[least, columns]
            lower = value < best
            best[lower] = value[lower]
            word[lower] = hashes[some[least[lower]]]
        repeated, times = ids[counts > 1], counts[counts > 1]
        for at in range(0, len(repeated), BLOCK_WORDS):
            some = repeated[at : at + BLOCK_WORDS]
            logs = np.log(times[at : at + BLOCK_WORDS]).astype(np.float32)[:, None]
            step = np.floor(logs / r[some] + beta[some])
            ranks = log_c[some] - r[some] * (step - beta[some] + 1)
            least = ranks.argmin(axis=0)
            value = ranks[least, columns]
            lower = value < best
            best[lower] = value[lower]
            word[lower] = hashes[some[least[lower]]]
            level[lower] = step[least, columns][lower].astype(np.int64)
        mixed = _mix(word + level.astype(np.uint64) * GOLDEN)
        return (mixed >> np.uint64(48)).astype("<u2")


def packed(signature: np.ndarray | None) -> bytes:
    """The samples as bytes, none for a text without words; results show them as hex digits."""
    return b"" if signature is None else signature.astype(">u2").tobytes()


def shown(column: str):
    return F.lower(F.hex(column)).alias(column)


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Share of equal samples; two texts without words are alike, one is unlike any other."""
    if a is None or b is None:
        return 1.0 if a is b else 0.0
    return float((a == b).mean())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fingerprint): hex of the signature, empty for a text without words."""

    def run(slices):
        sampler = Sampler()
        for rows in slices:
            signatures = sampler.signatures(rows["text"])
            yield {"doc_id": rows["doc_id"], "fingerprint": [packed(s) for s in signatures]}

    kind = dict(docs.dtypes)[id_col]
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(narrow, run, f"doc_id {kind}, fingerprint binary").select("doc_id", shown("fingerprint"))


RESULT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint binary, "
    "edited_fingerprint binary, near_edited double, near_next double"
)


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many first ones of the next document."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _compare(sampler: Sampler, ids: list, texts: list[str]) -> dict[str, list]:
    """Results of all texts but the last, each against the one after it."""
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    signatures = sampler.signatures(texts + changed)
    own, other = signatures[: len(texts)], signatures[len(texts) :]
    return {
        "doc_id": ids[:-1],
        "n_chars": [len(t) for t in texts[:-1]],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
        "fingerprint": [packed(s) for s in own[:-1]],
        "edited_fingerprint": [packed(s) for s in other],
        "near_edited": [likeness(a, b) for a, b in zip(own, other)],
        "near_next": [likeness(a, b) for a, b in zip(own, own[1:])],
    }


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, its edited text and their likeness (columns as in RESULT, fingerprints in hex).

    The next document is the one after it in descending order of id (nulls last,
    equal ids by text), the first one after the last. Documents are dealt by ranges
    of the id and the text's start; a task streams its range with one document held back. What meets at
    the edges of ranges, two documents per task, is compared in a second step.
    A null text is empty; a table of one row is its own next document.
    """
    ids, texts = F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col), F.lit(""))
    ordered = (
        docs.select(ids.alias("doc_id"), texts.alias("text"))
        .repartitionByRange(F.desc_nulls_last("doc_id"), F.substring("text", 1, DEALT_CHARS))
        .sortWithinPartitions(F.desc_nulls_last("doc_id"), "text")
    )
    schema = f"{RESULT}, part int, edge int, text string"

    def run(slices):
        part = TaskContext.get().partitionId()
        sampler, held = Sampler(), None

        def edge(row, kind):
            blank = {name: [None] for name in _compare(sampler, [], [""])}
            return blank | {"doc_id": [row[0]], "text": [row[1]], "part": [part], "edge": [kind]}

        for rows in slices:
            if held is None:
                yield edge((rows["doc_id"][0], rows["text"][0]), 0)
                at, all_texts = rows["doc_id"], rows["text"]
            else:
                at, all_texts = [held[0], *rows["doc_id"]], [held[1], *rows["text"]]
            held = (at[-1], all_texts[-1])
            found = _compare(sampler, at, all_texts)
            count = len(at) - 1
            yield found | {"text": [None] * count, "part": [part] * count, "edge": [None] * count}
        if held is not None:
            yield edge(held, 1)

    compared = reliable(map_rows(ordered, run, schema))
    # Two rows per task: the first of a range (0) and the last (1), which lacks its next.
    edges = compared.where("edge is not null").select("doc_id", "text", "part", "edge")
    firsts = edges.where("edge = 0").select(F.col("part").alias("next"), F.col("text").alias("next_text"))
    # Ranges are chained by their numbers alone, the last one to the first.
    every_part = Window.orderBy("part")
    following = F.coalesce(
        F.lead("part").over(every_part),
        F.first("part").over(every_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    )
    chain = edges.where("edge = 0").select("part").withColumn("next", following)
    lasts = (
        edges.where("edge = 1").select("doc_id", "text", "part").join(chain, "part").join(firsts, "next")
        .select("doc_id", "text", "next_text")
    )

    def finish(slices):
        sampler = Sampler()
        for rows in slices:
            for at, text, following in zip(rows["doc_id"], rows["text"], rows["next_text"]):
                yield _compare(sampler, [at, None], [text, following])

    rest = map_rows(lasts, finish, RESULT)
    every = compared.where("edge is null").select(rest.columns).unionByName(rest)
    return every.withColumns({c: shown(c) for c in ("fingerprint", "edited_fingerprint")})
