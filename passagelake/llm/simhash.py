"""SimHash near-duplicates: candidates by the pigeonring principle, then Hamming distance.

A 64-bit fingerprint is a ring of 16 segments of 4 bits. If two fingerprints differ
in at most 3 bits, then from some segment on *every* run of l consecutive segments
holds at most floor(3 l / 16) of the differences: none in the first 5 segments, at
most 1 in the first 10, at most 2 in the first 15. Of the segments 6 to 10, either
6 to 8 or 9 and 10 are therefore free of differences, which gives two exact keys
of 32 and 28 bits for each of the 16 starts. Rows that share a key are held against
the chain's budgets, and only then against the full distance.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from passagelake.llm.common import map_rows
from passagelake.llm.graph import connected_components
from passagelake.session import reliable

BITS = 64
SEGMENTS = 16
WIDTH = BITS // SEGMENTS
MAX_DISTANCE = 3
SHINGLE_WORDS = 3
SEED = 42


def simhash(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Fingerprint of one text: the bits set in over half the shingle hashes."""
    import xxhash

    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    shingles = zip(*(tokens[i:] for i in range(words)))
    hashes = np.fromiter(
        (digest(join(s), SEED) for s in shingles), dtype="<u8", count=len(tokens) - words + 1
    )
    set_bits = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), 65536):
        block = hashes[start : start + 65536]
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int32)
    over = set_bits * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp): the fingerprint of every text as a signed 64-bit number.

    A null, empty or blank text has fingerprint zero. Texts of any length are taken whole.
    """

    def run(slices):
        for rows in slices:
            values = np.array([simhash(t) for t in rows["text"]], dtype=np.uint64)
            yield {"doc_id": rows["doc_id"], "fp": values.view(np.int64)}

    kind = dict(docs.dtypes)[id_col]
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(narrow, run, f"doc_id {kind}, fp bigint")


def _rotated(fp: Column, start: int) -> Column:
    """The ring read from segment ``start`` on; the first segment is highest."""
    bits = start * WIDTH
    if not bits:
        return fp
    return F.shiftleft(fp, bits).bitwiseOR(F.shiftrightunsigned(fp, BITS - bits))


def chain_keys(fp: Column) -> Column:
    """The 32 exact keys of a fingerprint, each with the number of its start and kind."""
    keys = []
    for start in range(SEGMENTS):
        ring = _rotated(fp, start)
        first = F.shiftrightunsigned(ring, 44)  # segments 1 to 5
        head = F.shiftrightunsigned(ring, 32)  # segments 1 to 8
        tail = F.shiftleft(first, 8).bitwiseOR(F.shiftrightunsigned(ring, 24).bitwiseAND(F.lit(255)))
        keys.append(F.lit(start * 2).cast("bigint") * F.lit(1 << 32) + head)
        keys.append(F.lit(start * 2 + 1).cast("bigint") * F.lit(1 << 32) + tail)
    return F.array(*keys)


def within_budgets(a: Column, b: Column, key: Column) -> Column:
    """The chain from the key's start keeps its budgets, and the whole distance is at most 3."""
    differing = a.bitwiseXOR(b)
    start = F.shiftright(key, 33).cast("int") * WIDTH
    # The shifts of the SQL engine take the amount modulo 64, so a start of 0 works too.
    ring = F.call_function("shiftleft", differing, start).bitwiseOR(
        F.call_function("shiftrightunsigned", differing, F.lit(BITS) - start)
    )
    return (
        (F.bit_count(F.shiftrightunsigned(ring, 24)) <= 1)
        & (F.bit_count(F.shiftrightunsigned(ring, 4)) <= 2)
        & (F.bit_count(differing) <= MAX_DISTANCE)
    )


def fingerprint_classes(prints: DataFrame) -> DataFrame:
    """Rows (fp, class_fp) for the distinct fingerprints that have a link, by reachability.

    Fingerprints sharing a key are first linked to the key's smallest and largest
    one, which joins dense families in linear work. Only keys that still hold
    several components are joined with themselves, for links across components;
    thus no link is lost, and a family of near copies does not give all its pairs.
    """
    distinct = prints.select("fp").where("fp is not null").distinct()
    keyed = distinct.select("fp", F.explode(chain_keys(F.col("fp"))).alias("key"))
    ends = keyed.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high"))
    # Spark takes the exploded rows for no more than the fingerprints and would broadcast them.
    shared = reliable(keyed.join(ends.where("low < high").hint("merge"), "key"))
    fp, key = F.col("fp"), F.col("key")
    stars = [
        shared.where((fp != F.col(end)) & within_budgets(fp, F.col(end), key)).select(
            fp.alias("a"), F.col(end).alias("b")
        )
        for end in ("low", "high")
    ]
    first = reliable(connected_components(stars[0].unionByName(stars[1])))
    placed = shared.select("key", "fp").join(first.withColumnRenamed("node", "fp"), "fp", "left").select(
        "key", "fp", F.coalesce("component", "fp").alias("component")
    )
    mixed = placed.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high")
    ).where("low < high")
    open_rows = reliable(placed.join(mixed.select("key"), "key"))
    # Their file is many times smaller than the rows in memory.
    a, b = open_rows.alias("a"), open_rows.hint("merge").alias("b")
    across = a.join(
        b,
        (F.col("a.key") == F.col("b.key"))
        & (F.col("a.component") < F.col("b.component"))
        & within_budgets(F.col("a.fp"), F.col("b.fp"), F.col("a.key")),
    ).select(F.col("a.component").alias("a"), F.col("b.component").alias("b"))
    second = reliable(connected_components(across.distinct()))
    # A fingerprint linked only across components is a component of its own until here.
    moved = second.select(F.col("node").alias("component"), F.col("component").alias("class_fp"))
    members = first.select(F.col("node").alias("fp"), "component").unionByName(
        second.select(F.col("node").alias("fp"), F.col("node").alias("component"))
    )
    return (
        members.distinct()
        .join(moved, "component", "left")
        .select("fp", F.coalesce("class_fp", "component").alias("class_fp"))
        .groupBy("fp")
        .agg(F.min("class_fp").alias("class_fp"))
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp, class_fp, component_id (smallest doc_id of its class).

    Rows with the same id each keep their row. A class in which all ids are null has
    a null component. An empty table gives an empty result.
    """
    prints = reliable(fingerprints(docs, id_col, text_col))
    classes = fingerprint_classes(prints)
    by_print = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    classed = reliable(
        by_print.join(classes, "fp", "left").withColumn("class_fp", F.coalesce("class_fp", "fp"))
    )
    smallest = classed.groupBy("class_fp").agg(F.min("first_id").alias("component_id"))
    labels = classed.select("fp", "class_fp").join(smallest, "class_fp")
    # The file of many copies is small, but has a row for every document.
    return prints.join(labels.hint("merge"), "fp").select("doc_id", "fp", "class_fp", "component_id")
