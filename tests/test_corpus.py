import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from passagelake.sources.corpus import (
    DAMAGED,
    NOT_NUMBERED,
    files_to_fetch,
    keep_language,
    language_summary,
    number_lines,
    parse_documents,
    read_corpus,
    read_documents,
    read_in_order,
    read_lines,
    sample_missing_files,
)
from passagelake.sources.export import export_documents, export_summary, plan_shards


def write_gz(folder, name, lines):
    with gzip.open(os.path.join(folder, name), "wb") as out:
        out.write("\n".join(lines).encode())


@pytest.fixture
def corpus(tmp_path):
    folder = str(tmp_path)
    write_gz(
        folder,
        "train-00000.jsonl.gz",
        [
            "",
            "   ",
            json.dumps({"id": "a", "text": "first\rsame line"}),
            "{broken",
            json.dumps({"text": "no id"}),
            json.dumps({"id": None, "text": "null id"}),
            json.dumps({"id": "e", "text": ""}),
            json.dumps({"id": "n"}),
            "[1, 2]",
            json.dumps({"id": 12, "text": "number id", "lang": "en"}),
        ],
    )
    write_gz(folder, "train-00001.jsonl.gz", [json.dumps({"text": f"t{i}"}) for i in range(2500)])
    write_gz(folder, "train-00002.jsonl.gz", [json.dumps({"id": "z", "text": "last"})])
    return folder


def test_defaults_and_rejects(spark, corpus):
    rows = read_documents(spark, f"{corpus}/train-00000.jsonl.gz").collect()
    short = {(r.id.rsplit("/", 1)[-1], r.text) for r in rows}
    assert short == {
        ("a", "first\rsame line"),
        ("train-00000.jsonl.gz_2", "no id"),
        ("train-00000.jsonl.gz_3", "null id"),
        ("12", "number id"),
    }
    lines = number_lines(read_lines(spark, f"{corpus}/train-00000.jsonl.gz"))
    rejected = parse_documents(lines, F.col("line_num")).where("reason is not null")
    assert sorted(r.value for r in rejected.collect()) == ["[1, 2]", "{broken"]


def test_line_numbers_over_many_batches(spark, corpus):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rows = read_documents(spark, f"{corpus}/train-00001.jsonl.gz").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(int(r.id.rsplit("_", 1)[1]), r.text) for r in rows} == {(i, f"t{i}") for i in range(2500)}


def test_plain_text_split_into_blocks(spark, tmp_path):
    with open(tmp_path / "train-00000.jsonl", "w") as out:
        out.write("\n\n")
        for i in range(4000):
            out.write(json.dumps({"text": f"t{i}"}) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        lines = read_lines(spark, str(tmp_path))
        assert lines.select("block_start").distinct().count() > 3
        rows = read_documents(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(int(r.id.rsplit("_", 1)[1]), r.text) for r in rows} == {(i, f"t{i}") for i in range(4000)}


def test_file_range_and_unreadable_file(spark, corpus):
    with open(f"{corpus}/train-00003.jsonl.gz", "wb") as out:
        out.write(b"not a gzip file")
    some = read_documents(spark, corpus, first_file=1, end_file=4)
    files = {r[0].rsplit("/", 1)[-1] for r in some.select("source_file").distinct().collect()}
    assert files == {"train-00001.jsonl.gz", "train-00002.jsonl.gz"}
    assert some.count() == 2501


def test_ids_without_numbering_stay_on_the_jvm(spark, corpus):
    rows = read_documents(spark, f"{corpus}/train-00002.jsonl.gz", number_missing_ids=False)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and "Python" not in plan
    assert [r.id for r in rows.collect()] == ["z"]
    numbered = read_documents(spark, f"{corpus}/train-00000.jsonl.gz")
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and "Python" not in plan


def test_numbers_of_six_digits_and_none(spark, tmp_path):
    for name in ("train-00003", "train-99999", "train-100000", "train-123456", "notes"):
        write_gz(str(tmp_path), f"{name}.jsonl.gz", [json.dumps({"id": name, "text": "t"})])
    found = read_corpus(spark, str(tmp_path), first_file=0)
    assert {r.id for r in found.documents.collect()} == {"train-00003", "train-99999", "train-100000", "train-123456"}
    (left,) = found.skipped.collect()
    assert left.source_file.endswith("notes.jsonl.gz") and left.reason == NOT_NUMBERED
    late = read_documents(spark, str(tmp_path), first_file=100_000)
    assert {r.id for r in late.collect()} == {"train-100000", "train-123456"}
    assert read_documents(spark, str(tmp_path)).count() == 5


def test_a_damaged_file_is_left_out_whole_and_listed(spark, corpus):
    whole = open(f"{corpus}/train-00001.jsonl.gz", "rb").read()
    with open(f"{corpus}/train-00004.jsonl.gz", "wb") as out:
        out.write(whole[: len(whole) // 2])
    with open(f"{corpus}/train-00005.jsonl.gz", "wb") as out:
        out.write(whole + gzip.compress(b"\n") + whole)  # members make one whole file
    with open(f"{corpus}/train-00006.jsonl.gz", "wb") as out:
        out.write(whole + whole[:-3])
    found = read_corpus(spark, corpus)
    report = {r.source_file.rsplit("/", 1)[-1]: tuple(r)[1:] for r in found.report().collect()}
    assert report == {
        "train-00000.jsonl.gz": (4, 2, 2, None),
        "train-00001.jsonl.gz": (2500, 0, 0, None),
        "train-00002.jsonl.gz": (1, 0, 0, None),
        "train-00004.jsonl.gz": (0, 0, 0, DAMAGED),
        "train-00005.jsonl.gz": (5000, 0, 0, None),
        "train-00006.jsonl.gz": (0, 0, 0, DAMAGED),
    }
    assert {r.value for r in found.rejected.where("reason = 'Invalid JSON'").collect()} == {"[1, 2]", "{broken"}
    ids = [r.id for r in found.documents.collect()]
    assert len(ids) == len(set(ids)) == 7505


def test_language_walk_over_many_ranges(spark):
    files = spark.range(20_000).selectExpr("id n", "if(id % 3 = 0, 'en', 'de') lang").repartition(16)
    for wanted in (1, 2, 777, 6667):
        row = language_summary(keep_language(files, "n", min_files=wanted)).first()
        assert tuple(row) == (wanted, 2 * (wanted - 1))


def test_positions_follow_the_files(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(1000).selectExpr("id", "id * 2 as twice").repartitionByRange(7, "id").write.parquet(path)
    rows = read_in_order(spark, path).collect()
    assert all(r.position == r.id for r in rows) and len(rows) == 1000


def test_export_is_exact_and_readable(spark, tmp_path):
    path, out = str(tmp_path / "rows"), str(tmp_path / "out")
    source = spark.range(1000).selectExpr("cast(id as string) id", "concat('text ', id) text", "cast(null as string) lang")
    source.repartitionByRange(7, F.col("id").cast("int")).write.parquet(path)
    rows = read_in_order(spark, path)
    export_documents(rows, out, split="train", chunk_size=300)
    for shard, size in enumerate([300, 300, 300, 100]):
        folder = f"{out}/shard_name=train-{shard:05d}"
        (name,) = [n for n in os.listdir(folder) if n.endswith(".json.gz")]
        with gzip.open(f"{folder}/{name}", "rt") as lines:
            records = [json.loads(line) for line in lines]
        assert [int(r["id"]) for r in records] == list(range(shard * 300, shard * 300 + size))
        assert records[0]["lang"] is None
    back = read_documents(spark, out, first_file=1, end_file=3)
    assert sorted(int(r.id) for r in back.collect()) == list(range(300, 900))
    row = export_summary(plan_shards(rows, 300), "rows", "train", out).first()
    assert (row.chunks_uploaded, row.documents_uploaded) == (4, 1000) and row.bytes_uploaded > 0
    export_documents(rows, out, chunk_size=300, max_chunks=2)
    assert sorted(n for n in os.listdir(out) if n.startswith("shard")) == [
        "shard_name=train-00000",
        "shard_name=train-00001",
    ]


def test_export_arguments(spark):
    rows = spark.range(3).withColumnRenamed("id", "position")
    for bad in ({"chunk_size": 0}, {"max_chunks": 0}):
        with pytest.raises(ValueError):
            plan_shards(rows, **bad)


def test_fetching_missing_files(spark):
    index = spark.range(5000).selectExpr("concat('f', id) path")
    stored = spark.range(0, 5000, 2).selectExpr("concat('f', id) path")
    sample = sample_missing_files(index, stored, target_mb=1000, avg_file_mb=10, seed=1)
    again = sample_missing_files(index.repartition(13), stored, target_mb=1000, avg_file_mb=10, seed=1)
    assert sample.count() == 100 and sample.exceptAll(again).count() == 0
    assert all(r.already_stored == (int(r.path[1:]) % 2 == 0) for r in sample.collect())
    assert files_to_fetch(10, 100) == 1


def test_language_walk(spark):
    files = spark.createDataFrame(
        [(0, "en"), (1, "fr"), (2, None), (3, "en"), (4, "de"), (5, "en")], "n int, lang string"
    )
    assert tuple(language_summary(keep_language(files, "n", min_files=2)).first()) == (2, 2)
    assert tuple(language_summary(keep_language(files, "n", min_files=9)).first()) == (3, 3)
    assert tuple(language_summary(keep_language(files, "n")).first()) == (3, 3)


def test_language_walk_does_not_depend_on_the_plan(spark):
    files = spark.range(20_000).select(F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, "en").otherwise("de").alias("lang"))
    files = files.repartition(7, F.xxhash64("n"))
    settings = {"spark.sql.exchange.reuse": "false", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        for wanted in (1, 2500, 4999):
            walked = keep_language(files, "n", min_files=wanted).agg(F.max("n"), F.count_if("kept")).first()
            assert tuple(walked) == (3 * (wanted - 1), wanted)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
