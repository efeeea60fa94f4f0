"""Text to vectors in Arrow batches, behind one hook for any model."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from passagelake.functions.vectors import list_column

BATCH_TEXTS = 256
TOKEN_BREAK = r"[^\p{L}\p{N}]+"
#: Tokens whose buckets are kept, and the longest of them.
KEPT_TOKENS = 300_000
LONGEST_KEPT = 64
# Bytes of UTF-8, those of ASCII characters that are no letter or digit as spaces.
_SPACED = np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], dtype=np.uint8)


class HashingEmbedder:
    """Offline lexical vectors: token counts hashed into ``dim`` buckets, unit length.

    It stands in for a language model: deterministic, but no notion of meaning.
    """

    #: Texts of a call: the more, the fewer words differ.
    batch_texts = 4096

    def __init__(self, dim: int = 64):
        self.dim = dim
        self.known: dict[str, int] = {}

    def bucket(self, token: str) -> int:
        return int.from_bytes(hashlib.md5(token.encode()).digest()[:4], "big") % self.dim

    def _buckets(self, tokens: list[str]) -> np.ndarray:
        """Buckets of tokens, -1 for an empty one; those of short tokens are kept."""
        known = self.known
        if len(known) > KEPT_TOKENS:
            known.clear()
        found = [known.get(t) for t in tokens]
        for i, token in enumerate(tokens):
            if found[i] is None:
                found[i] = self.bucket(token) if token else -1
                if len(token) <= LONGEST_KEPT:
                    known[token] = found[i]
        return np.array(found, dtype=np.int64)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        rows, words = _words(pc.utf8_lower(texts))
        codes, words = words.indices.to_numpy(zero_copy_only=False), words.dictionary
        # Words with other than ASCII characters may still hold several tokens, or none.
        plain = pc.string_is_ascii(words).to_numpy(zero_copy_only=False)
        buckets = np.empty(len(words), dtype=np.int64)
        buckets[plain] = self._buckets(words.filter(pa.array(plain)).to_pylist())
        if not plain.all():
            wide = np.flatnonzero(~plain)
            parts = pc.split_pattern_regex(words.take(pa.array(wide)), TOKEN_BREAK)
            inner = self._buckets(pc.list_flatten(parts).to_pylist())
            sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.cumsum(sizes) - sizes
            single = sizes == 1
            buckets[wide[single]] = inner[starts[single]]
            # Words that are cut stand nowhere themselves; their tokens come behind the others.
            cut, place = wide[~single], np.full(len(words), -1)
            buckets[cut], place[cut] = -1, np.flatnonzero(~single)
            at = np.flatnonzero(place[codes] >= 0)
            word = place[codes[at]]
            times = sizes[word]
            first = np.repeat(starts[word] - (np.cumsum(times) - times), times)
            hits = np.concatenate([buckets[codes], inner[first + np.arange(int(times.sum()))]])
            rows = np.concatenate([rows, np.repeat(rows[at], times)])
        else:
            hits = buckets[codes]
        cells = (rows * self.dim + hits)[hits >= 0]
        counts = np.bincount(cells, minlength=len(texts) * self.dim)
        counts = counts.reshape(len(texts), self.dim).astype(np.float64)
        norms = np.sqrt(np.square(counts).sum(axis=1, keepdims=True))
        return np.divide(counts, norms, out=np.zeros_like(counts), where=norms > 0)


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(text, word) of what stands between ASCII characters that are no letter or digit; some words are empty."""
    if not pa.types.is_string(texts.type):
        texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    size = int(places[-1] - places[0])
    spaced = _SPACED[np.frombuffer(data, np.uint8, size, int(places[0]))] if size else np.empty(0, np.uint8)
    texts = pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(places - places[0]), pa.py_buffer(spaced))
    tokens = pc.split_pattern(texts, " ")
    return pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False), pc.list_flatten(tokens).dictionary_encode()


def _loaded(key: str, factory: Callable[[], Callable]):
    """Load a model once per Python worker; workers are reused between tasks."""
    models = sys.__dict__.setdefault("_passagelake_models", {})
    if key not in models:
        models[key] = factory()
    return models[key]


def embed_column(
    text: Column,
    factory: Callable[[], Callable[[pa.Array], np.ndarray]] = HashingEmbedder,
    key: str | None = None,
    batch_texts: int | None = None,
) -> Column:
    """Embed a text column as ``array<float>``; null text gives a null vector.

    ``factory`` builds a callable from an Arrow string array to a (rows, dim)
    matrix. It runs once per worker process, when ``key`` is given (the model's
    name and version), or once per task otherwise. A call gets ``batch_texts`` texts at most; by
    default as many as the model's own ``batch_texts`` says, or BATCH_TEXTS.
    """

    @F.arrow_udf("array<float>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _loaded(key, factory) if key else factory()
        at_once = batch_texts or getattr(model, "batch_texts", BATCH_TEXTS)
        for batch in batches:
            if isinstance(batch, pa.ChunkedArray):
                batch = batch.combine_chunks()
            texts = batch.fill_null("")
            parts = [
                np.asarray(model(texts[at : at + at_once]), dtype=np.float32)
                for at in range(0, len(texts), at_once)
            ]
            if not parts:
                yield pa.array([], type=pa.list_(pa.float32()))
                continue
            vectors = list_column(np.vstack(parts))
            if batch.null_count:
                vectors = pc.if_else(batch.is_valid(), vectors, pa.scalar(None, vectors.type))
            yield vectors

    # Keeps the optimizer from running the model again below a filter.
    return embed.asNondeterministic()(text)
