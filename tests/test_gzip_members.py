import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from passagelake.session import reliable
from passagelake.sources import gzip_members
from passagelake.sources.gzip_members import index_members, listed_files, member_runs, read_runs, write_members


def lines_of(text):
    """Lines with their places behind the blank ones in front."""
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    first = next((i for i, line in enumerate(lines) if line.strip()), 0)
    return [(line, i - first) for i, line in enumerate(lines)]


@pytest.mark.parametrize("run_bytes", [1, 300, 10_000_000])
def test_lines_of_many_members_are_those_of_the_whole_text(spark, tmp_path, run_bytes):
    """Members begin and end anywhere: in lines, in characters, many in one line."""
    rng = random.Random(run_bytes)
    texts = {
        "a": "\n 　\n" + "".join(f"line {i} {'ä' * rng.randrange(40)}\n" for i in range(400)),
        "b": "x" * 3000 + "\n" + "y" * 2000,
        "c": "one\n\ntwo\n\n\n",
        "d": "no end",
        "e": "\n\n",
    }
    for name, text in texts.items():
        data, members = text.encode(), []
        while data:
            cut = rng.randrange(1, 400)
            members.append(gzip.compress(data[:cut]))
            data = data[cut:]
        (tmp_path / f"{name}.gz").write_bytes(b"".join(members) + gzip.compress(b""))
    members = reliable(index_members(listed_files(spark, str(tmp_path))))
    assert members.where("not whole").isEmpty()
    found = {}
    for row in read_runs(member_runs(members, run_bytes)).collect():
        found.setdefault(os.path.basename(row.path)[0], []).append((row.value, row.line_num))
    assert {n: sorted(rows, key=lambda r: r[1]) for n, rows in found.items()} == {n: lines_of(t) for n, t in texts.items()}


def test_one_file_is_read_by_several_tasks_and_never_held(spark, tmp_path):
    lines = spark.range(60_000).select(F.concat(F.lit("text number "), "id", F.lit(" "), F.sha2(F.col("id").cast("string"), 256)).alias("value"))
    write_members(lines.coalesce(1), str(tmp_path / "c"), member_bytes=100_000)
    (name,) = os.listdir(tmp_path / "c")
    with gzip.open(tmp_path / "c" / name, "rt") as file:
        assert [line.rstrip("\n") for line in file] == [r.value for r in lines.collect()]
    members = reliable(index_members(listed_files(spark, str(tmp_path / "c"))))
    runs = member_runs(members, 200_000)
    assert members.count() > 40 and runs.count() > 8
    read = read_runs(runs).withColumn("task", F.spark_partition_id())
    assert read.select("task").distinct().count() > 4
    assert read.agg(F.count("*"), F.count_distinct("line_num"), F.min("line_num"), F.max("line_num")).first()[:] == (60_000, 60_000, 0, 59_999)
    assert read.select("value").exceptAll(lines).isEmpty()


def test_pieces_of_the_text_are_bounded(tmp_path):
    """A file that inflates to much more than it is goes through in pieces."""
    path = tmp_path / "z.gz"
    path.write_bytes(gzip.compress(b"0" * 50_000_000) * 2)
    with open(path, "rb") as stream:
        sizes = [(len(text), ended) for text, _, ended in gzip_members._inflated(stream)]
    assert sum(n for n, _ in sizes) == 100_000_000 and max(n for n, _ in sizes) <= gzip_members.PIECE_BYTES
    assert sum(ended for _, ended in sizes) == 2


def test_damaged_files_are_told_and_not_read(spark, tmp_path):
    good = gzip.compress(b"a\nb\n")
    files = {"good": good * 2, "cut": good + good[:-4], "bits": good + b"noise", "plain": b"text\n"}
    for name, data in files.items():
        (tmp_path / f"{name}.gz").write_bytes(data)
    members = reliable(index_members(listed_files(spark, str(tmp_path))))
    broken = {os.path.basename(r.path) for r in members.where("not whole").collect()}
    assert broken == {"cut.gz", "bits.gz", "plain.gz"}
    rows = read_runs(member_runs(members)).collect()
    assert sorted((r.value, r.line_num) for r in rows) == [("a", 0), ("a", 2), ("b", 1), ("b", 3)]
    assert read_runs(member_runs(members.where("false"))).count() == 0


def test_writing_nothing(spark, tmp_path):
    write_members(spark.range(0).select(F.col("id").cast("string").alias("value")), str(tmp_path / "none"))
    assert not os.path.exists(tmp_path / "none") or not os.listdir(tmp_path / "none")
