"""Passages from paragraphs that are rows: the packing rule where a document exceeds a task.

``chunking.pack_paragraphs`` folds over a document's paragraphs in one row. Here a document may
have more of them than a task can hold. The rule is greedy, so where a passage ends depends on
where it started, and that on all before. But a passage has ``max_words`` paragraphs at most,
so a block of paragraphs can only be entered at one of its first ``max_words`` places. Each
block is therefore packed once for every way to enter it, by itself, which gives a map from
entry to the next block's entry. Maps of neighbouring blocks compose, and doubling (each block's
map composed with that of the block twice as far back) gives every block its real entry in as many
rounds as the number of blocks in the longest document has binary digits. With the entries known, each block
numbers its own passages.

Rows are dealt and sorted by ranges first. A document that is one block at most and lies between two others
of its range is entered at its start, so the task that reads it packs it there, in Arrow batches. What is
left for blocks are longer documents and those at the two ends of a range, which may go on in the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from passagelake.functions.text import strip, word_count
from passagelake.operators.chunking import JOINER, MAX_WORDS
from passagelake.session import reliable

#: Paragraphs in a block.
BLOCK_ROWS = 4096


def _changes(docs: pa.Array) -> np.ndarray:
    """Where another document begins in a sorted column without nulls."""
    before, after = docs[:-1], docs[1:]
    if pa.types.is_nested(docs.type):
        listed = docs.to_pylist()
        differ = np.array([a != b for a, b in zip(listed, listed[1:])], dtype=bool)
    else:
        differ = pc.not_equal(before, after)
        if pa.types.is_floating(docs.type):
            differ = pc.and_not(differ, pc.and_(pc.is_nan(before), pc.is_nan(after)))
        differ = differ.to_numpy(zero_copy_only=False)
    return np.append(len(docs) > 0, differ)[: len(docs)]


def _passages(rows: pa.Table, max_words: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(first row, ordinal, chunk) of the passages of whole documents, one after the other."""
    begins = np.flatnonzero(_changes(rows.column("doc").combine_chunks()))
    ends = np.append(begins[1:], rows.num_rows)
    follows = _next_starts(rows.column("words").to_numpy(), max_words).tolist()
    starts, ordinals = [], []
    for at, end in zip(begins.tolist(), ends.tolist()):
        ordinal = 0
        # A passage ends with its document.
        while at < end:
            starts.append(at)
            ordinals.append(ordinal)
            at, ordinal = follows[at], ordinal + 1
    offsets = pa.array([*starts, rows.num_rows], pa.int32())
    texts = rows.column("paragraph").combine_chunks()
    chunks = pc.binary_join(pa.ListArray.from_arrays(offsets, texts), JOINER)
    return np.array(starts, dtype=np.int64), np.array(ordinals, dtype=np.int64), chunks


def _packer(max_words: int, block_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs the documents inside a sorted range; longer ones and those at its ends go on as rows, see RANGED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        # The rows of the last document so far, and how many of it have gone on.
        held: pa.Table | None = None
        gone, first = 0, True

        def loose(rows: pa.Table, place: np.ndarray) -> pa.RecordBatch:
            n = rows.num_rows
            return pa.RecordBatch.from_arrays(
                [rows.column("doc").combine_chunks(), pa.nulls(n, pa.int64()), pa.array(np.full(n, part, np.int32)),
                 pa.array(place, pa.int64()), rows.column("paragraph").combine_chunks(), rows.column("words").combine_chunks()],
                names=RANGED,
            )

        def packed(rows: pa.Table) -> pa.RecordBatch:
            starts, ordinals, chunks = _passages(rows, max_words)
            n = len(starts)
            return pa.RecordBatch.from_arrays(
                [rows.column("doc").combine_chunks().take(pa.array(starts)), pa.array(ordinals), pa.nulls(n, pa.int32()),
                 pa.nulls(n, pa.int64()), chunks, pa.nulls(n, pa.int32())],
                names=RANGED,
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if held is not None:
                # Rows that have gone on leave one behind, to tell whether their document goes on.
                rows = pa.concat_tables([held.slice(max(0, held.num_rows - 1)) if gone else held, rows])
            rows = rows.combine_chunks()
            begins = np.flatnonzero(_changes(rows.column("doc").combine_chunks()))
            sizes = np.diff(np.append(begins, rows.num_rows))
            seen = 1 if gone else 0
            place = np.arange(rows.num_rows) - np.repeat(begins, sizes)
            place[: sizes[0]] += gone - seen
            by_block = sizes > block_rows
            by_block[0] |= first or gone > 0
            last = by_block[-1]
            chosen = np.repeat(by_block, sizes)
            inside = ~chosen
            chosen[:seen] = False
            if not last:
                inside[begins[-1] :] = False
            if chosen.any():
                yield loose(rows.filter(pa.array(chosen)), place[chosen])
            if inside.any():
                yield packed(rows.filter(pa.array(inside)))
            held = rows.slice(int(begins[-1]))
            gone = int(place[-1]) + 1 if last else 0
            first = first and len(begins) == 1
        if held is not None and not gone:
            yield loose(held, np.arange(held.num_rows))

    return run


#: What a range gives: passages (with an ordinal) and rows that are left (with range and place in it).
RANGED = ["doc", "ordinal", "range", "place", "paragraph", "words"]


def _ranged(paragraphs: DataFrame, doc_col: str, order_col: str, text_col: str, max_words: int, block_rows: int) -> DataFrame:
    """Passages and left rows, see RANGED; blank and null paragraphs and those without a document are left out.

    Rows of equal place are ordered by their text, a null place comes first.
    """
    text = strip(F.col(text_col))
    rows = paragraphs.select(F.col(doc_col).alias("doc"), F.col(order_col).alias("_at"), text.alias("paragraph")).where(
        F.col("doc").isNotNull() & (F.col("paragraph") != "")
    )
    # Words are counted behind the shuffle: drawing the ranges reads the rows once more.
    order = ["doc", "_at", "paragraph"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.select("doc", "paragraph", word_count(F.col("paragraph")).alias("words"))
    doc_field = dealt.schema["doc"].simpleString().replace(":", " ", 1)
    schema = f"{doc_field}, ordinal bigint, range int, place bigint, paragraph string, words int"
    # Ranges are drawn from a sample: stored, since all that follows must see the same ones.
    return reliable(dealt.mapInArrow(_packer(max_words, block_rows), schema))


def number_paragraphs(left: DataFrame) -> DataFrame:
    """doc, position (0, 1, ... in each document), paragraph, words of the rows that ranges left."""
    # One row per document and range that it lies in.
    counts = left.groupBy("doc", "range").agg((F.max("place") + 1).alias("_n"))
    before = Window.partitionBy("doc").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("doc", "range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return left.join(bases, ["doc", "range"]).select(
        "doc", (F.col("_base") + F.col("place")).alias("position"), "paragraph", "words"
    )


def _next_starts(words: np.ndarray, max_words: int) -> np.ndarray:
    """Where the passage after the one that starts at each place starts."""
    sums = np.concatenate([[0], np.cumsum(words)])
    after = np.searchsorted(sums, sums[:-1] + max_words, side="right") - 1
    # A paragraph above the limit is a passage of its own.
    return np.maximum(after, np.arange(len(words)) + 1)


def _entries(rows: DataFrame, max_words: int, block_rows: int) -> DataFrame:
    """doc, block, entry: the place in each block where its first passage starts.

    ``rows`` has doc, block, place, words. A block whose rows all belong to a passage from before is entered
    beyond its end: at its size or later.
    """
    doc_field = rows.schema["doc"].simpleString().replace(":", " ", 1)
    target = pa.schema([("block", pa.int64()), ("leave", pa.list_(pa.int32()))])

    def ways(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        at = group.column("place").to_numpy()
        words = group.column("words").to_numpy()
        # Rows past the end are those of the next block that a passage can reach.
        own = int((at < block_rows).sum())
        follows = np.arange(len(words) + 1)
        follows[:-1] = _next_starts(words, max_words)
        # Successors doubled until each place points to the first start at or past the end.
        leave = np.where(np.arange(len(follows)) < own, follows, np.arange(len(follows)))
        while (leave[:own] < own).any():
            leave = leave[leave]
        entries = min(max_words, own)
        out = pa.table([pa.array([group.column("block")[0].as_py()]), pa.array([(leave[:entries] - own).tolist()])], schema=target)
        return out.add_column(0, "doc", group.column("doc").slice(0, 1))

    reach = F.when((F.col("block") > 0) & (F.col("place") < max_words), F.array("block", F.col("block") - 1))
    seen = rows.select(
        "doc", "block", "place", "words", F.explode(F.coalesce(reach, F.array("block"))).alias("_for")
    ).select(
        "doc",
        F.col("_for").alias("block"),
        (F.col("place") + F.when(F.col("_for") == F.col("block"), 0).otherwise(block_rows)).alias("place"),
        "words",
    )
    maps = reliable(seen.groupBy("doc", "block").applyInArrow(ways, f"{doc_field}, block bigint, leave array<int>"))

    # A document is entered at 0, so a composed map that reaches back to its first block is a number.
    # ``leave`` of block b after r rounds: from the entry of block b - 2^r + 1 to that of block b + 1.
    longest = maps.agg(F.max("block")).first()[0] or 0
    far = 1
    while far <= longest:
        earlier = maps.select("doc", (F.col("block") + far).alias("block"), F.col("leave").alias("_before"))
        joined = maps.join(earlier, ["doc", "block"], "left")
        through = F.transform("_before", lambda e: F.get(F.col("leave"), e))
        maps = reliable(joined.select("doc", "block", F.coalesce(through, F.col("leave")).alias("leave")))
        far *= 2
    first = rows.select("doc").distinct().select("doc", F.lit(0).cast("bigint").alias("block"), F.lit(0).alias("entry"))
    later = maps.select("doc", (F.col("block") + 1).alias("block"), F.get("leave", F.lit(0)).alias("entry"))
    return first.unionByName(later)


def pack_rows(
    paragraphs: DataFrame,
    doc_col: str = "doc_id",
    order_col: str = "paragraph",
    text_col: str = "text",
    max_words: int = MAX_WORDS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per passage, as ``chunk_documents`` gives from whole texts: doc_id, ordinal, chunk, chunk_id.

    ``paragraphs`` has one row per paragraph, ordered by ``order_col`` within a document. Blank and null
    paragraphs are no part of any passage, and documents of nothing else give none, as do rows without
    a document. Repeated rows are paragraphs of their own, and rows of one id are one document. A passage is put together from ``max_words``
    paragraphs at most; no task needs more than a block and what a passage reaches of the next.
    """
    if max_words < 1 or block_rows < max_words:
        raise ValueError("a block must hold a passage")
    ranged = _ranged(paragraphs, doc_col, order_col, text_col, max_words, block_rows)
    whole = ranged.where("ordinal IS NOT NULL").select("doc", "ordinal", F.col("paragraph").alias("chunk"))
    numbered = number_paragraphs(ranged.where("ordinal IS NULL").drop("ordinal")).select(
        "doc",
        F.floor(F.col("position") / block_rows).alias("block"),
        (F.col("position") % block_rows).cast("int").alias("place"),
        "paragraph",
        "words",
    )
    numbered = reliable(numbered)
    entries = _entries(numbered.select("doc", "block", "place", "words"), max_words, block_rows)
    doc_field = numbered.schema["doc"].simpleString().replace(":", " ", 1)

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        follows = _next_starts(group.column("words").to_numpy(), max_words)
        at, starts = group.column("entry")[0].as_py(), []
        while at < len(follows):
            starts.append(at)
            at = follows[at]
        # Paragraphs before a block's first start belong to the last passage before.
        begun = np.searchsorted(starts, np.arange(len(follows)), side="right")
        out = group.select(["doc", "block", "place", "paragraph"])
        return out.append_column("begun", pa.array(begun, pa.int64()))

    begun = reliable(
        numbered.join(entries, ["doc", "block"])
        .groupBy("doc", "block")
        .applyInArrow(pack, f"{doc_field}, block bigint, place int, paragraph string, begun bigint")
    )
    # One row per block of a document.
    earlier = Window.partitionBy("doc").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = begun.groupBy("doc", "block").agg(F.max("begun").alias("_n"))
    bases = starts.select("doc", "block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    placed = begun.join(bases, ["doc", "block"]).withColumn("ordinal", F.col("_base") + F.col("begun") - 1)
    parts = F.sort_array(F.collect_list(F.struct("block", "place", "paragraph")))
    doc = F.col("doc").cast("string")
    chunk = F.array_join(F.transform(parts, lambda p: p["paragraph"]), JOINER)
    return whole.unionByName(placed.groupBy("doc", "ordinal").agg(chunk.alias("chunk"))).select(
        doc.alias("doc_id"), "ordinal", "chunk", F.format_string("%s_chunk_%d", doc, "ordinal").alias("chunk_id")
    )
