"""SentencePiece encoding and decoding as shortest paths through a transducer.

The transducer is compiled from a model file: the normaliser (the model's map of
characters, then white space becomes U+2581, with one put in front), one arc chain per
piece, and byte arcs for a character that no piece has. Composing it with a text gives
a lattice of pieces; the text's pieces are its shortest path in the tropical semiring.
Pieces that the model's maker defined are taken wherever they stand, the longest first.

* Unigram models: an arc weighs minus its piece's score.
* BPE models: the pieces are those that merging gives. An arc from a state that was
  reached by piece p, over piece q, weighs 0 if merging p + q gives p, q again, and
  infinity (the semiring's zero) otherwise. One path of finite weight is left, the
  merged one, because merges only depend on neighbours.

A space between two other characters always starts a piece, so the words of a text
are composed one by one and their paths are kept in a bounded cache.
"""

from __future__ import annotations

import codecs
import re
import zlib
from math import inf

import numpy as np
from pyspark.sql import DataFrame, functions as F

from passagelake.llm.common import kept_in_worker, map_rows

SPACE = "▁"
PIECE = ""
#: Stands for the state before the first piece, and for a character that no piece has.
START = 1 << 31
CACHED_WORDS = 300_000
CACHED_PAIRS = 1_000_000
LONGEST_CACHED = 64


def each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    """Every byte that is no part of a character becomes U+FFFD, as in the library."""
    return "\ufffd" * (error.end - error.start), error.end


class CharacterMap:
    """The normaliser's map of characters: a double array of UTF-8 bytes, whose leaves are places of replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
        self.shown = blob[4 + size :]
        self.starting: dict[str, bool] = {}

    def _steps(self, key: bytes):
        """The leaf, or None, behind each byte of ``key`` as long as arcs for them are there."""
        units = self.units
        at = (units[0] >> 10) << ((units[0] & 1 << 9) >> 6)
        for byte in key:
            at ^= byte
            if at >= len(units) or units[at] & (1 << 31 | 0xFF) != byte:
                return
            unit = units[at]
            at ^= (unit >> 10) << ((unit & 1 << 9) >> 6)
            yield units[at] & ~(1 << 31) if unit >> 8 & 1 else None

    def _starts(self, character: str) -> bool:
        key = character.encode()
        return sum(1 for _ in self._steps(key)) == len(key)

    def _prefix(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes read, replacement) of the longest key at a place."""
        found = None
        for length, leaf in enumerate(self._steps(memoryview(text)[at:]), 1):
            if leaf is not None:
                found = length, leaf
        if found is None:
            return None
        return found[0], self.shown[found[1] : self.shown.index(b"\0", found[1])]

    def apply(self, text: str) -> str:
        starting = self.starting
        for character in set(text).difference(starting):
            starting[character] = self._starts(character)
        if not any(map(starting.__getitem__, set(text))):
            return text
        data, at, out = text.encode(), 0, []
        while at < len(data):
            found = self._prefix(data, at)
            if found is None:
                first = data[at]
                length = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                found = length, data[at : at + length]
            out.append(found[1])
            at += found[0]
        return b"".join(out).decode("utf-8", "replace")


class Transducer:
    """Compiled from the model file at ``path``."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        codecs.register_error("each_byte", each_byte)
        spec, kinds = model.normalizer_spec, pb.ModelProto.SentencePiece
        if model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only normalisers with leading white space are compiled")
        self.map = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.dummy, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.escape = spec.escape_whitespaces
        self.merging = model.trainer_spec.model_type == pb.TrainerSpec.BPE
        self.unknown = model.trainer_spec.unk_id
        self.ids, self.scores, self.bytes, self.shown = {}, [], {}, []
        lowest, highest, defined = 0.0, -inf, []
        for number, piece in enumerate(model.pieces):
            text = piece.piece
            self.scores.append(piece.score)
            if piece.type == kinds.BYTE:
                self.bytes[int(text[3:5], 16)] = number
                self.shown.append(bytes([int(text[3:5], 16)]))
            elif piece.type == kinds.CONTROL:
                self.shown.append(b"")
            elif piece.type == kinds.UNKNOWN:
                self.shown.append(" ⁇ ".encode())
            else:
                self.ids[text] = number
                if piece.type == kinds.USER_DEFINED:
                    defined.append(text)
                else:
                    lowest, highest = min(lowest, piece.score), max(highest, piece.score)
                self.shown.append(text.replace(SPACE, " ").encode())
        self.unknown_cost = 10.0 - lowest
        # Unigram models weigh them by their bytes, so that no other path is shorter.
        for text in defined:
            self.scores[self.ids[text]] = len(text.encode()) * (0.0 if highest == -inf else highest) - 0.1
        longest_first = "|".join(map(re.escape, sorted(defined, key=len, reverse=True)))
        self.defined = re.compile(f"({longest_first})") if defined else None
        self.longest = max(map(len, self.ids), default=1)
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        # The pieces as a trie: the arcs' states, a dictionary each, with the piece that ends there.
        self.names = {number: text for text, number in self.ids.items()}
        self.trie: dict = {}
        for text, number in self.ids.items():
            node = self.trie
            for character in text:
                node = node.setdefault(character, {})
            node[PIECE] = number
        self.words: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.edges: dict[int, tuple | None] = {}

    def normalise(self, text: str) -> str:
        there = bool(text)
        if self.map is not None:
            # Defined pieces are not mapped; every second part is one.
            parts = self.defined.split(text) if self.defined else [text]
            text = "".join([part if i % 2 else self.map.apply(part) for i, part in enumerate(parts)])
        if self.squeeze:
            text = " ".join(part for part in text.split(" ") if part)
            there = bool(text)
        if self.dummy and there:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    def merged(self, text: str) -> list[tuple]:
        """Parts by merging the neighbours whose joined piece scores best, leftmost first.

        A part is (its text, the rank that was reached when it was made, its first part and
        its last part through all merges, each a list of (text, rank reached)).
        """
        parts = [(c, -inf, [(c, -inf)], [(c, -inf)]) for c in text]
        ids, scores = self.ids, self.scores
        while len(parts) > 1:
            best, place = -inf, -1
            for i in range(len(parts) - 1):
                number = ids.get(parts[i][0] + parts[i + 1][0])
                if number is not None and scores[number] > best:
                    best, place = scores[number], i
            if place < 0:
                break
            left, right = parts[place], parts[place + 1]
            made = left[0] + right[0], max(-best, left[1], right[1])
            parts[place : place + 2] = [(*made, [*left[2], made], [*right[3], made])]
        return parts

    def _edges(self, piece: int) -> tuple[list, list] | None:
        """How a piece's first and last part grow as it is merged; None if merging does not give it."""
        if piece not in self.edges:
            parts = self.merged(self.names[piece])
            self.edges[piece] = parts[0][2:] if len(parts) == 1 else None
        return self.edges[piece]

    def allowed(self, left: int, right: int) -> bool:
        """The arc over piece ``right`` behind piece ``left`` has a finite weight; START stands for no piece."""
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        if left == START:
            found = self._edges(right) is not None
        else:
            found = self._edges(left) is not None and self._edges(right) is not None and self._apart(left, right)
        self.pairs[left << 32 | right] = found
        return found

    def _apart(self, left: int, right: int) -> bool:
        """No merge across the border of two pieces comes before those that make them.

        The last part of the left piece and the first part of the right one grow in the
        order of the ranks reached; a joined piece with a better rank would come first.
        """
        last, first = self._edges(left)[1], self._edges(right)[0]
        i = j = 0
        while True:
            number = self.ids.get(last[i][0] + first[j][0])
            across = inf if number is None else -self.scores[number]
            grow_left = last[i + 1][1] if i + 1 < len(last) else inf
            grow_right = first[j + 1][1] if j + 1 < len(first) else inf
            if across < inf and (across == grow_left or across == grow_right):
                # Equal ranks go by place: look at the merges themselves.
                names = [self.names[left], self.names[right]]
                return [part[0] for part in self.merged("".join(names))] == names
            if across < min(grow_left, grow_right):
                return False
            if grow_left == grow_right == inf:
                return True
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1

    def _arcs(self, word: str, start: int) -> list[tuple[int, int]]:
        """(end, piece) of the arcs that leave a position, the longest last. Without a piece: its bytes."""
        node, arcs = self.trie, []
        for end in range(start, len(word)):
            node = node.get(word[end])
            if node is None:
                break
            if PIECE in node:
                arcs.append((end + 1, node[PIECE]))
        return arcs if arcs and arcs[0][0] == start + 1 else [(start + 1, START), *arcs]

    def _fallback(self, character: str) -> list[int]:
        if not self.bytes:
            return [self.unknown]
        return [self.bytes[b] for b in character.encode()]

    def _merged_path(self, word: str) -> list[int]:
        """The path of finite weight, by depth-first search, longest arcs first.

        Every path of finite weight to a position is the merged form of the text before
        it, so there is one at most: a position that leads nowhere is never tried again.
        """
        pairs, length = self.pairs, len(word)
        at, last, arcs = 0, START, self._arcs(word, 0)
        taken: list[tuple[int, int, list, int]] = []
        dead: set[int] = set()
        while at < length:
            while arcs:
                end, piece = arcs.pop()
                if end in dead:
                    continue
                # A character without a piece takes part in no merge: it parts the word.
                if piece != START:
                    found = pairs.get(last << 32 | piece)
                    if not (self.allowed(last, piece) if found is None else found):
                        continue
                taken.append((at, last, arcs, piece))
                at, last = end, piece
                arcs = self._arcs(word, at) if at < length else []
                break
            else:
                if not taken:
                    raise ValueError(f"no path for {word!r}: the model's pieces are not reached by merging")
                dead.add(at)
                at, last, arcs, _ = taken.pop()
        path = []
        for start, _, _, piece in taken:
            if piece == START:
                path.extend(self._fallback(word[start]))
            else:
                path.append(piece)
        return path

    def _weighted_path(self, word: str) -> list[int]:
        """Viterbi search with arcs that weigh minus their piece's score."""
        best, back = [0.0], [(0, [])]
        for end in range(1, len(word) + 1):
            cost, via = inf, None
            for start in range(max(0, end - self.longest), end):
                number = self.ids.get(word[start:end])
                if number is not None and best[start] - self.scores[number] < cost:
                    cost, via = best[start] - self.scores[number], (start, [number])
            if word[end - 1] not in self.ids and best[end - 1] + self.unknown_cost < cost:
                cost, via = best[end - 1] + self.unknown_cost, (end - 1, self._fallback(word[end - 1]))
            best.append(cost)
            back.append(via)
        path, end = [], len(word)
        while end:
            end, ids = back[end]
            path.append(ids)
        return [i for ids in reversed(path) for i in ids]

    def _word(self, word: str) -> bytes:
        if not self.merging:
            path = self._weighted_path(word)
        elif self.defined is None:
            path = self._merged_path(word)
        else:
            # Merges do not cross a defined piece.
            path = []
            for i, part in enumerate(self.defined.split(word)):
                path += [self.ids[part]] if i % 2 else self._merged_path(part)
        return np.array(path, dtype="<i4").tobytes()

    def _split(self, text: str) -> list[str]:
        """Words with the white space before them; runs of white space stay together."""
        if not self.by_word:
            return [text]
        parts = text.split(SPACE)
        words, held = [], parts[0]
        for part in parts[1:]:
            if held and held[-1] != SPACE:
                words.append(held)
                held = ""
            held += SPACE + part
        if held:
            words.append(held)
        return words

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of the whole text; null and empty texts have none."""
        if not text:
            return np.empty(0, dtype="<i4")
        cache = self.words
        if len(cache) > CACHED_WORDS:
            cache.clear()
        out = []
        for word in self._split(self.normalise(text)):
            ids = cache.get(word)
            if ids is None:
                ids = self._word(word)
                if len(word) <= LONGEST_CACHED:
                    cache[word] = ids
            out.append(ids)
        path = np.frombuffer(b"".join(out), dtype="<i4")
        if not self.bytes and len(path):
            # Neighbouring characters without a piece are one unknown piece.
            unknown = path == self.unknown
            path = path[np.append(True, ~(unknown[1:] & unknown[:-1]))]
        return path

    def decode(self, ids) -> str:
        """The text of the ids; each byte of a broken sequence becomes U+FFFD."""
        shown = self.shown
        text = b"".join([shown[i] for i in ids]).decode("utf-8", "each_byte")
        return text[1:] if self.dummy and text[:1] == " " else text


def encode_documents(
    docs: DataFrame, model_path: str, text_col: str = "text", keep_ids: bool = True, keep_decoded: bool = False
) -> DataFrame:
    """``docs`` with token_ids and decoded (if kept), n_tokens, n_byte_tokens, ids_crc32 and round_trip.

    ``decoded`` is the text that the ids give, null for a null text; ``round_trip``: it is
    the text itself. The columns are computed in place, nothing is shuffled. Columns of
    ``docs`` with one of these names are replaced.
    """
    added = ["n_tokens", "n_byte_tokens", "ids_crc32", "round_trip"]
    added = (["token_ids"] if keep_ids else []) + added + (["decoded"] if keep_decoded else [])
    kept = [c for c in docs.columns if c.lower() not in added]
    kinds = {"token_ids": "array<int>", "round_trip": "boolean", "decoded": "string"}

    def run(slices):
        transducer = kept_in_worker((Transducer.__name__, model_path), lambda: Transducer(model_path))
        is_byte = np.zeros(len(transducer.shown), dtype=bool)
        is_byte[list(transducer.bytes.values())] = True
        for rows in slices:
            texts = rows["_text"]
            found = [transducer.encode(t) for t in texts]
            decoded = [None if t is None else transducer.decode(ids.tolist()) for t, ids in zip(texts, found)]
            out = {c: rows[c] for c in kept}
            out["n_tokens"] = [len(ids) for ids in found]
            out["n_byte_tokens"] = [int(is_byte[ids].sum()) for ids in found]
            out["ids_crc32"] = [zlib.crc32(ids.tobytes()) for ids in found]
            out["round_trip"] = [None if t is None else d == t for t, d in zip(texts, decoded)]
            if keep_ids:
                out["token_ids"] = found
            if keep_decoded:
                out["decoded"] = decoded
            yield out

    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_text"]
    fields += [f"{name} {kinds.get(name, 'bigint')}" for name in added]
    return map_rows(source, run, ", ".join(fields))


def decode_documents(rows: DataFrame, model_path: str, ids_col: str = "token_ids") -> DataFrame:
    """``rows`` with ``decoded``, the text of a column of ids; null ids have none. A column of that name is replaced.

    An id that the model lacks is an error.
    """
    kept = [c for c in rows.columns if c.lower() != "decoded"]

    def run(slices):
        transducer = kept_in_worker((Transducer.__name__, model_path), lambda: Transducer(model_path))
        for part in slices:
            out = {c: part[c] for c in kept}
            out["decoded"] = [None if ids is None else transducer.decode(ids) for ids in part["_ids"]]
            yield out

    source = rows.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids_col}`").alias("_ids"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_ids"]
    return map_rows(source, run, ", ".join([*fields, "decoded string"]))
