"""Alignment of two tokenizers' tokens over the same bytes, by pointer jumping.

A text's bytes are cut by a byte-level vocabulary (A) and by a SentencePiece model (B).
Places where a token of both ends cut the tokens into groups, the connected components of
"overlaps with". Every token points to its farthest-right overlapping token of the other
side, or to itself if both end together; ``successor = successor[successor]`` doubles the
steps until each token points to the last token of its component, which labels the group.

Both tokenizers start a new token at a single space between two other characters, so a
group never reaches across one: the different words of a batch are aligned together, as one
long array, and kept. A text then is a list of words. Texts with other spacing are cut
where there are such spaces, and whole texts are aligned where there are none.

Two ids are linked where they share a group. The corpus-wide count of a pair is the number
of documents that hold it: tasks count their documents' pairs, the sums are made by a
shuffle of counts, and each document's pairs, kept in a table, look them up. The table of
counts is sent to the tasks in parts of bounded size.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from passagelake.llm.common import kept_in_worker, map_rows
from passagelake.llm.token_files import JOINED_WORDS, PieceEncoder, byte_characters
from passagelake.session import reliable

SPACE = "▁"
#: Words and tokens that a worker keeps; then it starts anew.
CACHED_WORDS, CACHED_TOKENS = 200_000, 2_000_000
#: Words aligned in one array.
LEARNED_WORDS = 20_000
#: Pairs that a task counts at once, and that are sent to the tasks at once.
COUNTED_PAIRS = 1_000_000
PART_PAIRS = 2_000_000

ALIGNED = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "groups string, pairs binary, times binary"
)


def terminals(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """The last B token of the component of each A token, then of each B token.

    Both arrays hold the ascending ends of tokens that cover the same bytes.
    """
    n = len(a_ends)
    to_b = np.searchsorted(b_ends, a_ends)
    to_a = np.searchsorted(a_ends, b_ends)
    together = a_ends[to_a] == b_ends
    successor = np.concatenate([n + to_b, np.where(together, n + np.arange(len(b_ends)), to_a)])
    while True:
        further = successor[successor]
        if np.array_equal(further, successor):
            return successor - n
        successor = further


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] numbers), starts[1], ..."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


class Words:
    """Aligned words by their text: numbers of tokens, groups and links, the groups as text, the pairs.

    A word's row is its place in all of the arrays; ``BAD`` stands for words whose bytes are not kept.
    """

    NUMBERS = ("a", "b", "groups", "links", "first", "n_pairs")

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.texts: list[str] = [""]
        self.numbers = {n: np.zeros(1, dtype=np.int64) for n in self.NUMBERS}
        self.pairs, self.times = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.tokens = 0

    BAD = 0

    def add(self, words: list[str], texts: list[str], pairs: np.ndarray, times: np.ndarray, **numbers) -> None:
        numbers["first"] = numbers["first"] + len(self.pairs)
        self.rows.update(zip(words, range(len(self.texts), len(self.texts) + len(words))))
        self.texts += texts
        for name, held in self.numbers.items():
            self.numbers[name] = np.concatenate([held, numbers[name]])
        self.pairs, self.times = np.concatenate([self.pairs, pairs]), np.concatenate([self.times, times])
        self.tokens += int(numbers["a"].sum() + numbers["b"].sum())


class Aligner:
    """Align the tokens of whole texts. A word is what stands behind a space that both cut at."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor

        self.a = PieceEncoder(a_path, end_id=None)
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        tokenizer = self.a.tokenizer
        size = tokenizer.get_vocab_size()
        self.a_bytes = []
        for number in range(size):
            entry = tokenizer.id_to_token(number) or ""
            shown = all(c in byte_of for c in entry)
            self.a_bytes.append(bytes(byte_of[c] for c in entry) if shown else entry.encode())
        self.b = SentencePieceProcessor(model_file=b_path)
        self.b_bytes = []
        for number in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(number)
            whole = bytes([int(piece[3:5], 16)]) if self.b.is_byte(number) else piece.replace(SPACE, " ").encode()
            self.b_bytes.append(whole)
        pieces = map(self.b.id_to_piece, range(self.b.get_piece_size()))
        #: No piece of B reaches from one word into the next.
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.narrow = max(len(self.a_bytes), len(self.b_bytes)) <= 1 << 16
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        self.known = Words()

    def words(self, text: str) -> list[str]:
        if not self.by_word:
            return [text]
        return [piece[1:] for piece in PieceEncoder.pieces(" " + text)]

    def _a_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # Words are kept aligned, so the encoder's own cache is passed by.
        found = list(map(self.a._letters, words))
        plain, other = [], []
        for i, ids in enumerate(found):
            if ids is None:
                word = words[i]
                (plain if word and " " not in word and len(word.strip()) == len(word) else other).append(i)
        for places, encode in ((plain, self.a._joined), (other, lambda some: self.a._encode([" " + w for w in some]))):
            for at in range(0, len(places), JOINED_WORDS):
                part = places[at : at + JOINED_WORDS]
                for i, ids in zip(part, encode([words[i] for i in part])):
                    found[i] = ids
        size = self.a.dtype.itemsize
        ids = np.frombuffer(b"".join(found), dtype=self.a.dtype).astype(np.int64)
        return ids, np.array([len(f) // size for f in found], dtype=np.int64)

    def _b_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.b.encode(words, num_threads=1)
        counts = np.array([len(f) for f in found], dtype=np.int64)
        return np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(counts.sum())), counts

    def _kept(self, words, a, a_counts, b, b_counts) -> np.ndarray:
        """Which words' tokens join to their bytes, on both sides, and have a byte each."""
        spelled = [f" {w}".encode() for w in words]
        joined = b"".join(spelled)
        sides = ((a, a_counts, self.a_bytes, self.a_sizes), (b, b_counts, self.b_bytes, self.b_sizes))
        sizes = np.array([len(s) for s in spelled])
        kept = np.ones(len(words), dtype=bool)
        for ids, counts, table, size in sides:
            each = size[ids]
            ends = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(counts)])]
            same = b"".join([table[i] for i in ids.tolist()]) == joined
            if same and (np.diff(ends) == sizes).all() and (each > 0).all():
                continue
            first = np.cumsum(counts) - counts
            for i, (at, n) in enumerate(zip(first.tolist(), counts.tolist())):
                own = [table[t] for t in ids[at : at + n].tolist()]
                kept[i] &= all(own) and b"".join(own) == spelled[i]
        return kept

    def _learn(self, words: list[str]) -> None:
        """Align new words, all in one."""
        (a, a_counts), (b, b_counts) = self._a_ids(words), self._b_ids(words)
        kept = self._kept(words, a, a_counts, b, b_counts)
        if not kept.all():
            self.known.rows.update((w, Words.BAD) for w, k in zip(words, kept.tolist()) if not k)
            a, b = a[np.repeat(kept, a_counts)], b[np.repeat(kept, b_counts)]
            a_counts, b_counts = a_counts[kept], b_counts[kept]
            words = [w for w, k in zip(words, kept.tolist()) if k]
            if not words:
                return
        last = terminals(np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b]))
        # Groups numbered in order: their terminals are the B tokens that point to themselves.
        ends = np.flatnonzero(last[len(a) :] == np.arange(len(b)))
        group = np.searchsorted(ends, last)
        a_group, b_group = group[: len(a)], group[len(a) :]
        word_of_group = np.searchsorted(np.cumsum(b_counts), ends, "right")
        per_a, per_b = np.bincount(a_group, minlength=len(ends)), np.bincount(b_group, minlength=len(ends))
        links = np.bincount(word_of_group, weights=per_a * per_b, minlength=len(words)).astype(np.int64)
        pairs, times, word_of = self._linked(a, b, a_group, b_group, word_of_group)
        counts = np.bincount(word_of, minlength=len(words))
        self.known.add(
            words, self._shown(a, b, a_group, b_group, a_counts + b_counts), pairs, times, a=a_counts, b=b_counts,
            groups=np.bincount(word_of_group, minlength=len(words)), links=links,
            first=np.cumsum(counts) - counts, n_pairs=counts,
        )

    def _shown(self, a, b, a_group, b_group, counts) -> list[str]:
        """The groups of each word as ``a1,a2|b1;a3|b2``; ``counts`` has the words' tokens."""
        group = np.concatenate([a_group, b_group])
        side = np.repeat([0, 1], [len(a), len(b)])
        order = np.argsort(2 * group + side, kind="stable")
        group, side, ids = group[order], side[order], np.concatenate([a, b])[order]
        more = np.append((group[1:] == group[:-1]) & (side[1:] == side[:-1]), False)
        mark = np.where(more, 0, 1 + side)
        marks = (",", "|", ";")
        shown = [f"{i}{marks[m]}" for i, m in zip(ids.tolist(), mark.tolist())]
        bounds = np.concatenate([[0], np.cumsum(counts)]).tolist()
        # A word ends with a group.
        return ["".join(shown[x:y])[:-1] for x, y in zip(bounds, bounds[1:])]

    def _linked(self, a, b, a_group, b_group, word_of_group):
        """Different pairs of each word with the times they are linked: (pair, times, word), ordered by word."""
        shift = 1 << 32
        ga, times_a = np.unique(a_group * shift + a, return_counts=True)
        gb, times_b = np.unique(b_group * shift + b, return_counts=True)
        b_start = np.searchsorted(gb, (ga >> 32) * shift)
        counts = np.searchsorted(gb, ((ga >> 32) + 1) * shift) - b_start
        other = _ranges(b_start, counts)
        pair = np.repeat(ga % shift, counts) * shift + gb[other] % shift
        times = np.repeat(times_a, counts) * times_b[other]
        words = np.repeat(word_of_group[ga >> 32], counts)
        order = np.lexsort((pair, words))
        pair, times, words = pair[order], times[order], words[order]
        first = np.flatnonzero((np.diff(pair, prepend=-1) != 0) | (np.diff(words, prepend=-1) != 0))
        return pair[first], np.add.reduceat(times, first), words[first]

    def align(self, texts: list[str | None], keep_groups: bool = False) -> dict[str, list]:
        """The columns of ALIGNED but doc_id."""
        out: dict[str, list] = {n: [0] * len(texts) for n in ("n_a", "n_b", "n_groups", "n_links")}
        out |= {"groups_sha256": [""] * len(texts), "groups": [None] * len(texts)}
        out |= {"pairs": [b""] * len(texts), "times": [b""] * len(texts)}
        if len(self.known.rows) > CACHED_WORDS or self.known.tokens > CACHED_TOKENS:
            self.known = Words()
        filled = [i for i, text in enumerate(texts) if text]
        if not filled:
            return out
        words, edges = self._split([texts[i] for i in filled])
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        different = coded.dictionary.to_pylist()
        rows = self.known.rows
        new = [w for w in different if w not in rows]
        for at in range(0, len(new), LEARNED_WORDS):
            self._learn(new[at : at + LEARNED_WORDS])
        row = np.array([rows[w] for w in different], dtype=np.int64)
        strings = [self.known.texts[r] for r in row.tolist()]
        bad = np.concatenate([[0], np.cumsum((row == Words.BAD)[codes])])
        sums = {}
        for name, of in (("n_a", "a"), ("n_b", "b"), ("n_groups", "groups"), ("n_links", "links")):
            sums[name] = np.concatenate([[0], np.cumsum(self.known.numbers[of][row][codes])])
        whole = bad[edges[1:]] == bad[edges[:-1]]
        pairs = self._pairs_of_texts(row, codes, edges)
        for i, text in enumerate(filled):
            a, b = edges[i], edges[i + 1]
            if not whole[i]:
                continue
            for name, total in sums.items():
                out[name][text] = int(total[b] - total[a])
            groups = ";".join([strings[c] for c in codes[a:b].tolist()])
            out["groups_sha256"][text] = hashlib.sha256(groups.encode()).hexdigest()
            if keep_groups:
                out["groups"][text] = groups
            out["pairs"][text], out["times"][text] = pairs[i]
        return out

    def _split(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts and where each text's begin."""
        lists = pc.split_pattern(pa.array(texts, type=pa.string()), " ") if self.by_word else None
        if lists is not None:
            edges = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.flatten()
            coded = flat.dictionary_encode()
            # A word with white space at an end, or none between two spaces, is cut otherwise.
            odd = [not w or len(w.strip()) != len(w) for w in coded.dictionary.to_pylist()]
            seen = np.concatenate([[0], np.cumsum(np.array(odd)[coded.indices.to_numpy()])])
            regular = seen[edges[1:]] == seen[edges[:-1]]
            if regular.all():
                return flat, edges
        parts, counts = [], []
        for i, text in enumerate(texts):
            if lists is not None and regular[i]:
                parts.append(flat.slice(edges[i], edges[i + 1] - edges[i]))
            else:
                parts.append(pa.array(self.words(text), type=pa.string()))
            counts.append(len(parts[-1]))
        return pa.concat_arrays(parts), np.concatenate([[0], np.cumsum(counts)])

    def _pairs_of_texts(self, row: np.ndarray, codes, edges) -> list[tuple[bytes, bytes]]:
        """The different pairs of each text in ascending order, and the times each is linked."""
        counts, firsts = self.known.numbers["n_pairs"][row], self.known.numbers["first"][row]
        at = _ranges(firsts, counts)
        pairs, dense = np.unique(self.known.pairs[at], return_inverse=True)
        times, firsts = self.known.times[at], np.cumsum(counts) - counts
        text = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        key, often = np.unique(text * len(row) + codes, return_counts=True)
        text, code = key // len(row), key % len(row)
        at = _ranges(firsts[code], counts[code])
        # Equal pairs of a text side by side, by one sort.
        key = np.repeat(text, counts[code]) * max(1, len(pairs)) + dense[at]
        key, place = np.unique(key, return_inverse=True)
        total = np.bincount(place, weights=np.repeat(often, counts[code]) * times[at], minlength=len(key))
        text, shown = key // max(1, len(pairs)), packed(pairs, self.narrow)[key % max(1, len(pairs))]
        total = total.astype("<i8")
        bounds = np.searchsorted(text, np.arange(len(edges))).tolist()
        return [(shown[x:y].tobytes(), _times(total[x:y])) for x, y in zip(bounds, bounds[1:])]


def _times(total: np.ndarray) -> bytes:
    return total.astype("<u8").tobytes() if total.max(initial=0) >= 1 << 32 else total.astype("<u4").tobytes()


def packed(pair: np.ndarray, narrow: bool) -> np.ndarray:
    """Pairs a << 32 | b in 32 bits if both vocabularies allow it."""
    return ((pair >> 32 << 16) | (pair & 0xFFFF)).astype("<u4") if narrow else pair.astype("<u8")


def unpacked(pairs: list[bytes], narrow: bool) -> np.ndarray:
    held = np.frombuffer(b"".join(pairs), dtype="<u4" if narrow else "<u8").astype(np.int64)
    return (held >> 16 << 32) | (held & 0xFFFF) if narrow else held


def align_documents(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False
) -> DataFrame:
    """The columns of ALIGNED for every document, as a table in the shared folder.

    A encodes a space and the text, B the text, in front of which it puts a space; strings of
    special tokens in a text are plain text. Texts that are null or empty, or whose tokens'
    bytes do not join to a space and the text, have no tokens: zeros, and '' for their
    groups. ``pairs`` holds the different linked pairs, ``times`` how often each is linked;
    ``groups`` is null unless asked for. Ids may be null or repeat; other columns are dropped.
    """
    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def align(slices):
        for rows in slices:
            aligner = kept_in_worker((Aligner.__name__, a_path, b_path), lambda: Aligner(a_path, b_path))
            yield {"doc_id": rows["doc_id"], **aligner.align(rows["text"], keep_groups)}

    return reliable(map_rows(narrow, align, ALIGNED))


def pair_counts(aligned: DataFrame, narrow: bool) -> DataFrame:
    """(pair, count, best): the documents that hold a pair of ids, a << 32 | b.

    ``best``: no pair with the same A id has a higher count.
    """

    def count(slices):
        pairs, counts = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        for rows in slices:
            more, seen = np.unique(unpacked(rows["pairs"], narrow), return_counts=True)
            pairs, place = np.unique(np.concatenate([pairs, more]), return_inverse=True)
            counts = np.bincount(place, weights=np.concatenate([counts, seen]), minlength=len(pairs)).astype(np.int64)
            if len(pairs) > COUNTED_PAIRS:
                yield {"pair": pairs, "count": counts}
                pairs, counts = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        yield {"pair": pairs, "count": counts}

    partial = map_rows(aligned.select("pairs"), count, "pair bigint, count bigint")
    counted = partial.groupBy("pair").agg(F.sum("count").alias("count"))
    highest = F.max("count").over(Window.partitionBy(F.shiftright("pair", 32)))
    return reliable(counted.withColumn("best", F.col("count") == highest))


def with_counts(aligned: DataFrame, counts: DataFrame, narrow: bool) -> DataFrame:
    """``aligned`` with n_best, the links that are best for their A id, and count_sum, the sum of all links' counts."""
    parts = max(1, -(-counts.count() // PART_PAIRS))
    out = aligned.withColumns({"n_best": F.lit(0).cast("bigint"), "count_sum": F.lit(0).cast("bigint")})
    for part in range(parts):
        held = counts.where(F.pmod(F.xxhash64("pair"), F.lit(parts)) == part).toArrow()
        table = [held[n].to_numpy() for n in ("pair", "count", "best")]
        order = np.argsort(table[0])
        sent = out.sparkSession.sparkContext.broadcast([column[order] for column in table])

        def look_up(slices, sent=sent):
            known, count, best = sent.value
            for rows in slices:
                pairs = unpacked(rows["pairs"], narrow)
                sizes = [len(p) // (4 if narrow else 8) for p in rows["pairs"]]
                times = [np.frombuffer(t, f"<u{len(t) // n}") if n else np.empty(0, "<u4") for t, n in zip(rows["times"], sizes)]
                times = np.concatenate([np.empty(0, dtype=np.int64), *times])
                place = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
                here = known[place] == pairs if len(known) else np.zeros(len(pairs), dtype=bool)
                held = times * here
                text = np.repeat(np.arange(len(sizes)), sizes)
                for name, weight in (("n_best", best), ("count_sum", count)):
                    each = held * (weight[place] if len(known) else 0)
                    total = np.zeros(len(sizes), dtype=np.int64)
                    np.add.at(total, text, each.astype(np.int64))
                    rows[name] = [x + y for x, y in zip(rows[name], total.tolist())]
                yield rows

        schema = f"{ALIGNED}, n_best bigint, count_sum bigint"
        out = map_rows(out.select(*aligned.columns, "n_best", "count_sum"), look_up, schema)
        if part < parts - 1:
            out = reliable(out)
    return out


def align(docs: DataFrame, a_path: str, b_path: str, **columns) -> DataFrame:
    """Per document doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups, if asked for).

    The checksum is that of the groups as ``a1,a2|b1;a3|b2,b3``; see ``align_documents``.
    """
    aligned = align_documents(docs, a_path, b_path, **columns)
    narrow = Aligner(a_path, b_path).narrow
    found = with_counts(aligned, pair_counts(aligned, narrow), narrow)
    shown = ["groups"] if columns.get("keep_groups") else []
    return found.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *shown
    )
