"""Documents to passages: greedy packing of paragraphs up to a word limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from passagelake.functions.text import BLANK_LINES, let, paragraphs, word_count

# The word limit of a passage and the paragraph joiner.
MAX_WORDS = 300
JOINER = "\n\n"


def pack_paragraphs(parts: Column, max_words: int = MAX_WORDS) -> Column:
    """Pack an array of paragraphs into an array of passages, JVM-side.

    Greedy packing depends on everything packed so far, so it is a fold and not
    a window frame. The fold carries only the start positions of the passages;
    the texts are cut out once at the end. A paragraph above the limit becomes a
    passage of its own and is never split.
    """
    state = F.struct(
        F.array().cast("array<int>").alias("starts"),
        F.lit(0).alias("words"),
        F.lit(0).alias("pos"),
    )

    def step(acc, words):
        opens = (acc["pos"] == 0) | (acc["words"] + words > max_words)
        return F.struct(
            F.when(opens, F.array_append(acc["starts"], acc["pos"]))
            .otherwise(acc["starts"])
            .alias("starts"),
            F.when(opens, words).otherwise(acc["words"] + words).alias("words"),
            (acc["pos"] + 1).alias("pos"),
        )

    def cut(bound):
        starts, texts = bound["starts"], bound["texts"]
        return F.transform(
            starts,
            lambda start, i: F.array_join(
                F.slice(
                    texts,
                    start + 1,
                    F.coalesce(F.get(starts, i + 1), F.size(texts)) - start,
                ),
                JOINER,
            ),
        )

    def fold(texts):
        counts = F.transform(texts, word_count)
        starts = F.aggregate(counts, state, step, lambda acc: acc["starts"])
        return let(F.struct(starts.alias("starts"), texts.alias("texts")), cut)

    return let(parts, fold)


def chunk_documents(
    documents: DataFrame,
    id_col: str = "id",
    text_col: str = "text",
    source_col: str = "source_file",
    max_words: int = MAX_WORDS,
    separator: str = BLANK_LINES,
) -> DataFrame:
    """One row per passage: chunk, doc_id, chunk_len, chunk_id, source_file, created_at.

    Narrow: every document is packed where it was read, nothing is shuffled. A
    document without id gives no passages, since theirs would share one id;
    ``documents_without_id`` gives those documents.
    """
    passages = pack_paragraphs(paragraphs(F.col(text_col), separator), max_words)
    usable = documents.where((F.col(text_col) != "") & F.col(id_col).isNotNull())
    exploded = usable.select(
        F.col(id_col).cast("string").alias("doc_id"),
        F.col(source_col).alias("source_file"),
        F.posexplode(passages).alias("ordinal", "chunk"),
    )
    return exploded.select(
        "chunk",
        "doc_id",
        F.length("chunk").alias("chunk_len"),
        F.format_string("%s_chunk_%d", "doc_id", "ordinal").alias("chunk_id"),
        "source_file",
        F.current_timestamp().alias("created_at"),
    )


def documents_without_id(documents: DataFrame, id_col: str = "id") -> DataFrame:
    """What ``chunk_documents`` leaves out for want of an id."""
    return documents.where(F.col(id_col).isNull())
