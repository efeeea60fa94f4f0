"""Passages from rows equal those folded from whole texts."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from passagelake.functions.text import LINE_ENDS
from passagelake.operators import row_packing
from passagelake.operators.chunking import chunk_documents
from passagelake.operators.row_packing import pack_rows

ROWS = "doc_id string, paragraph int, text string"


def lines(spark, texts):
    return spark.createDataFrame(
        [(d, i, line) for d, text in texts.items() for i, line in enumerate(text.split("\n"))], ROWS
    )


def folded(spark, texts, max_words):
    docs = spark.createDataFrame([(d, t, "s") for d, t in texts.items()], "id string, text string, source_file string")
    got = chunk_documents(docs, max_words=max_words, separator=LINE_ENDS).collect()
    return sorted((r.doc_id, r.chunk_id, r.chunk) for r in got)


def packed(spark, texts, max_words, block_rows):
    got = pack_rows(lines(spark, texts), max_words=max_words, block_rows=block_rows).collect()
    return sorted((r.doc_id, r.chunk_id, r.chunk) for r in got)


def random_text(draw, paragraphs, longest):
    return "\n".join(" ".join(f"w{draw.randrange(99)}" for _ in range(draw.randrange(longest))) for _ in range(paragraphs))


@pytest.mark.parametrize("max_words, block_rows", [(5, 5), (7, 16), (40, 64)])
def test_equals_the_fold(spark, max_words, block_rows):
    draw = random.Random(max_words)
    texts = {f"d{i}": random_text(draw, draw.choice([1, 3, 30, 300]), 9) for i in range(25)}
    texts["long"] = random_text(draw, 3000, 6)  # hundreds of blocks: many rounds of doubling
    texts["ones"] = "\n".join(["w"] * 700)
    texts["above"] = "\n".join([" ".join(["w"] * 50)] * 70)
    assert packed(spark, texts, max_words, block_rows) == folded(spark, texts, max_words)


def test_odd_rows(spark):
    rows = [("a", 0, "x y"), ("a", 1, None), ("a", 2, " \t"), ("a", None, "first"), (None, 0, "lost"), ("b", 0, ""), ("c", 1, "same"), ("c", 1, "same")]
    got = pack_rows(spark.createDataFrame(rows, ROWS).withColumn("doc", F.lit(1)).withColumn("block", F.lit(2)))
    assert sorted((r.doc_id, r.ordinal, r.chunk) for r in got.collect()) == [("a", 0, "first\n\nx y"), ("c", 0, "same\n\nsame")]
    assert pack_rows(spark.createDataFrame([], ROWS)).count() == 0
    with pytest.raises(ValueError):
        pack_rows(spark.createDataFrame([], ROWS), block_rows=10)


def test_order_of_input_does_not_matter(spark):
    draw = random.Random(4)
    texts = {"d": random_text(draw, 500, 5), "e": random_text(draw, 200, 5)}
    mixed = lines(spark, texts).orderBy(F.rand(3)).repartition(7)
    got = sorted((r.doc_id, r.chunk_id, r.chunk) for r in pack_rows(mixed, max_words=20, block_rows=32).collect())
    assert got == folded(spark, texts, 20)


def test_documents_inside_a_range_do_not_reach_the_blocks(spark, monkeypatch):
    # Before, every document took two calls of Python, one for each of its blocks twice.
    draw = random.Random(6)
    texts = {f"d{i:04}": random_text(draw, draw.choice([1, 2, 30, 200]), 9) for i in range(400)}
    left, number = [], row_packing.number_paragraphs

    def noted(rows):
        left.append(rows.select("doc").distinct().count())
        return number(rows)

    monkeypatch.setattr(row_packing, "number_paragraphs", noted)
    batch, key = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), "spark.sql.execution.arrow.maxRecordsPerBatch"
    try:
        for size in ("10000", "7", "1"):
            spark.conf.set(key, size)
            assert packed(spark, texts, 40, 64) == folded(spark, texts, 40)
    finally:
        spark.conf.set(key, batch)
    long = sum(len([p for p in t.split("\n") if p]) > 64 for t in texts.values())
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(left) == 3 and all(n <= long + 2 * partitions < 200 for n in left)


@pytest.mark.parametrize("kind", ["double", "struct<a:string,b:int>", "date", "bigint"])
def test_kinds_of_ids(spark, kind):
    ids = {"double": [1.5, float("nan"), -2.0], "struct<a:string,b:int>": [("x", 1), ("x", 2), ("y", None)],
           "date": [datetime.date(2020, 1, d) for d in (1, 2, 3)], "bigint": [3, -1, 7]}[kind]
    rows = [(d, i, f"p{i} w w") for i in range(7) for d in ids]
    got = pack_rows(spark.createDataFrame(rows, f"doc_id {kind}, paragraph int, text string").coalesce(1), max_words=7)
    assert got.count() == 12 and got.select("doc_id", "ordinal").distinct().count() == 12
    assert {r.chunk for r in got.where("ordinal = 3").collect()} == {"p6 w w"}
