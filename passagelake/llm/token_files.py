"""Token-id files: flat unsigned integers, 64-bit document offsets, memory-mapped reads.

A data set is a folder of shards in ascending document order. Shard ``s`` is

* ``tokens-<s>.bin``: the ids of its documents, little-endian and unsigned, 16-bit if
  the vocabulary allows it, else 32-bit,
* ``offsets-<s>.bin``: n + 1 little-endian unsigned 64-bit numbers; document i of
  the shard has the ids from offset i to offset i + 1,
* ``ids-<s>.bin``: the n document ids, little-endian signed 64-bit.

``shards.parquet`` has a row per shard: its documents, its tokens and the bytes of an id,
and with them the first token's place in the whole, the prefix sum of the shards before.
"""

from __future__ import annotations

import os
import zlib
from array import array
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from passagelake.llm.common import filesystem, kept_in_worker, map_rows, publish_file, shared_folder
from passagelake.session import scratch_folder

END_ID = 2
CACHED_WORDS = 250_000
LONGEST_CACHED = 64
#: Text encoded at once: in more of it, fewer of the words are different ones.
BATCH_CHARS = 8_000_000
#: What ends a word behind a letter.
PUNCTUATION = ".,;:!?)]}\"%"
#: New words encoded as one text.
JOINED_WORDS = 5_000
#: Rows of one id are dealt by so many characters of the text, which do not contradict its order.
DEALT_CHARS = 64


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves, the other bytes for characters from U+0100 on.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class PieceEncoder:
    """Encode whole texts through the library, each distinct word once.

    The pre-tokenizer always starts a new token at a single space between two
    characters that are not white space, so a text may be cut there and the ids
    joined. Texts with other spacing are cut at such spaces only.

    Words are found in array operations. New ones of letters go to the library's model, the
    others are encoded together, as one text, whose ids are cut by the words' bytes. Their ids are kept in two
    generations: when the young one is full it becomes the old one, whose words move
    back as they are seen again. Long words are not kept.

    With ``added_tokens``, the library's default, tokens added to the vocabulary
    (``<|endoftext|>``) keep their ids where a text spells them, and such texts are
    encoded whole. Without, they are spelled like any other text.
    """

    def __init__(self, path: str, end_id: int | None = END_ID, added_tokens: bool = False):
        # One thread per task: Spark runs a task on each core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        found = self.tokenizer.get_added_tokens_decoder().values() if added_tokens else ()
        #: What a text that is cut nowhere holds.
        self.added = [t.content for t in found]
        #: The bytes of each id: a character of a byte-level entry is a byte.
        names = map(self.tokenizer.id_to_token, range(self.tokenizer.get_vocab_size()))
        self.sizes = np.array([len(n or "") for n in names], dtype=np.int64)
        self.model = self.tokenizer.model
        self.shown = byte_characters()
        self.ends: dict[str, bytes] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        largest = max(self.tokenizer.get_vocab_size() - 1, end_id or 0)
        self.dtype = np.dtype("<u2" if largest < 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.end = np.array([] if end_id is None else [end_id], dtype=self.dtype)

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return [np.array(ids, dtype=self.dtype).tobytes() for ids in found]

    def _joined(self, words: list[str]) -> list[bytes]:
        """Ids of words led by a space, encoded as one text and cut where the words' bytes end."""
        text = " " + " ".join(words)
        if not any(content in text for content in self.added):
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.cumsum(self.sizes[ids])
            word_ends = np.cumsum([1 + len(w) if w.isascii() else 1 + len(w.encode()) for w in words])
            last = np.searchsorted(ends, word_ends)
            if last[-1] == len(ids) - 1 and (ends[last] == word_ends).all():
                held, size = ids.tobytes(), self.dtype.itemsize
                edges = [0, *((last + 1) * size).tolist()]
                return [held[x:y] for x, y in pairwise(edges)]
        return self._encode([" " + w for w in words])

    @staticmethod
    def pieces(text: str) -> list[str]:
        """Pieces of a text with any spacing; they join to the text and encode apart."""
        parts = text.split(" ")
        cut, held = [], parts[0]
        for left, right in pairwise(parts):
            if left and right and not left[-1].isspace() and not right[0].isspace():
                cut.append(held)
                held = " " + right
            else:
                held += " " + right
        cut.append(held)
        return cut

    def _letters(self, word: str) -> bytes | None:
        """Ids of a word of letters led by a space, and of the punctuation behind it; None for other words.

        A new token starts between a letter and the punctuation that ends a word, and letters
        alone are one pre-token, which goes to the library's model as it is.
        """
        stem = word.rstrip(PUNCTUATION)
        if not stem.isalpha():
            return None
        shown = stem if stem.isascii() else "".join([self.shown[b] for b in stem.encode()])
        ids = array(self.code, [t.id for t in self.model.tokenize(self.shown[32] + shown)]).tobytes()
        if len(stem) == len(word):
            return ids
        end = word[len(stem) :]
        known = self.ends.get(end)
        if known is None:
            if len(self.ends) > CACHED_WORDS:
                self.ends.clear()
            known = self.ends[end] = self._encode([end])[0]
        return ids + known

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of each of the different words, led by a space."""
        if len(self.young) > CACHED_WORDS:
            self.old, self.young = self.young, {}
        found = list(map(self.young.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        old, new = self.old, []
        for i in missing:
            found[i] = old.get(words[i])
            if found[i] is None:
                found[i] = self._letters(words[i])
            if found[i] is None:
                new.append(i)
        for at in range(0, len(new), JOINED_WORDS):
            part = new[at : at + JOINED_WORDS]
            for i, ids in zip(part, self._joined([words[i] for i in part])):
                found[i] = ids
        self.young.update((words[i], found[i]) for i in missing if len(words[i]) <= LONGEST_CACHED)
        return found

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each whole text, with the end id."""
        column = pa.array([t or "" for t in texts], type=pa.string())
        lists = pc.split_pattern(column, " ")
        edges = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        words = coded.dictionary.to_pylist()
        # Texts with a space next to other white space go another way.
        odd = np.array([not w or len(w.strip()) != len(w) for w in words], dtype=bool)
        seen = np.concatenate([[0], np.cumsum(odd[codes])])
        regular = seen[edges[1:]] == seen[edges[:-1]]
        whole = np.zeros(len(texts), dtype=bool)
        for content in self.added:
            whole |= pc.match_substring(column, content).to_numpy(zero_copy_only=False)
        regular &= ~whole
        plain = np.flatnonzero(~odd).tolist()
        found = [b""] * len(words)
        for i, ids in zip(plain, self._words([words[i] for i in plain])):
            found[i] = ids
        # The first word of a text has no space in front.
        first = edges[:-1][regular]
        heads, place = np.unique(codes[first], return_inverse=True)
        codes[first] = len(found) + place
        found += self._encode([words[i] for i in heads.tolist()]) if len(heads) else []
        out = []
        for i, text in enumerate(texts):
            if regular[i]:
                ids = b"".join([found[c] for c in codes[edges[i] : edges[i + 1]].tolist()])
            elif text:
                ids = b"".join(self._encode([text] if whole[i] else self.pieces(text)))
            else:
                ids = b""
            out.append(np.frombuffer(ids + self.end.tobytes(), dtype=self.dtype))
        return out


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int | None = END_ID,
    added_tokens: bool = False,
) -> str:
    """Encode every text and write the shards; returns the folder.

    Documents are dealt by ranges of the id and streamed in order through each
    task, which holds one batch and its shard's offsets. Null ids come first and
    are stored as the smallest number; rows with one id are ordered by text; a null
    text is empty (the end id alone). A task that runs again replaces its shard.
    ``added_tokens`` is that of PieceEncoder.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, folder or scratch_folder(spark, "tokens"))
    files, path = filesystem(folder)
    files.create_dir(path, recursive=True)
    narrow = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("doc_id"),
        F.col(text_col).alias("text"),
    )
    start = F.substring("text", 1, DEALT_CHARS)
    ordered = narrow.repartitionByRange("doc_id", start).sortWithinPartitions("doc_id", "text")

    def write(slices):
        context = TaskContext.get()
        shard, attempt = context.partitionId(), context.taskAttemptId()
        files, path = filesystem(folder)
        offsets, ids, total = [0], [], 0
        names = {n: f"{path}/{n}-{shard:06d}.bin" for n in ("tokens", "offsets", "ids")}
        out = None
        for rows in slices:
            if out is None:
                encoder = kept_in_worker(
                    (PieceEncoder.__name__, tokenizer_path, end_id, added_tokens),
                    lambda: PieceEncoder(tokenizer_path, end_id, added_tokens),
                )
                out = files.open_output_stream(f"{names['tokens']}.{attempt}")
            for found in encoder.encode_batch(rows["text"]):
                out.write(found.tobytes())
                total += len(found)
                offsets.append(total)
            ids.extend(rows["doc_id"])
        if out is None:
            return
        out.close()
        for name, numbers in (("offsets", np.array(offsets, "<u8")), ("ids", np.array(ids, "<i8"))):
            with files.open_output_stream(f"{names[name]}.{attempt}") as stream:
                stream.write(numbers.tobytes())
        for name in names.values():
            publish_file(files, f"{name}.{attempt}", name)
        yield {"shard": [shard], "docs": [len(ids)], "tokens": [total], "width": [encoder.dtype.itemsize]}

    schema = "shard int, docs bigint, tokens bigint, width int"
    map_rows(ordered, write, schema, BATCH_CHARS).write.mode("overwrite").parquet(f"{folder}/shards.parquet")
    return folder


def shard_bases(spark: SparkSession, folder: str) -> DataFrame:
    """Shards with ``base``, the tokens of all shards before: one small row per shard."""
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.parquet(f"{folder}/shards.parquet").withColumn(
        "base", F.coalesce(F.sum("tokens").over(earlier), F.lit(0))
    )


def mapped(files, path: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped where the file system is local, else read."""
    from pyarrow import fs as pafs

    if not files.get_file_info(path).size:
        return np.empty(0, dtype=dtype)
    if isinstance(files, pafs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r")
    with files.open_input_file(path) as stream:
        return np.frombuffer(stream.read_buffer(), dtype=dtype)


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents from the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, token_ids.

    A task takes whole shards, which were written at the size of a partition. The
    checksum is that of the ids as little-endian 32-bit numbers, whatever the file holds.
    """
    folder = shared_folder(spark, folder)
    shards = shard_bases(spark, folder).select("shard", "base", "width")
    count = max(1, shards.count())
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if with_ids:
        schema += ", token_ids array<bigint>"

    def read(batches):
        files, path = filesystem(folder)
        for batch in batches:
            for shard, base, width in zip(batch["shard"], batch["base"], batch["width"]):
                offsets = mapped(files, f"{path}/offsets-{shard:06d}.bin", "<u8").astype(np.int64)
                ids = mapped(files, f"{path}/ids-{shard:06d}.bin", "<i8")
                tokens = mapped(files, f"{path}/tokens-{shard:06d}.bin", f"<u{width}")
                for at in range(0, len(ids), 1000):
                    edges = offsets[at : at + 1001]
                    spans = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
                    rows = {
                        "doc_id": pa.array(ids[at : at + 1000], mask=ids[at : at + 1000] == -(1 << 63)),
                        "start": edges[:-1] + base,
                        "n_tokens": np.diff(edges),
                        "ids_crc32": [zlib.crc32(tokens[a:b].astype("<u4")) for a, b in spans],
                    }
                    if with_ids:
                        rows["token_ids"] = [tokens[a:b].tolist() for a, b in spans]
                    yield rows

    return map_rows(shards.repartition(min(count, 10_000), "shard"), read, schema)
