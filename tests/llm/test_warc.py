import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from passagelake.llm.common import filesystem, shared_folder
from passagelake.llm.queries import op7_warc
from passagelake.llm.warc import (
    BAD_CHUNKS,
    MISSING,
    WRONG_DIGEST,
    WRONG_LENGTH,
    chunked,
    dechunked,
    parse_records,
    read_archives,
    read_records,
    record,
    write_archives,
)

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id bigint, url string, html string, payload string"


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_query_covers_the_pages(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op7_warc(spark, SF).collect()
    assert {r["page_id"]: r["payload_digest"] for r in rows} == {i: digest(h) for i, h in pages.items()}
    assert all(r["payload_bytes"] == len(pages[r["page_id"]].encode()) for r in rows)


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h/{i}", f"<p>page {i} é</p>" * (1 + 997 * i % 4001), "clash") for i in range(40)]
    rows += [(100 + i, "http://copy/", rows[3][2], None) for i in range(30)]
    rows += [(200, None, None, None), (201, "u", "", ""), (202, "multi\r\nline: url", "<p>z</p>", None)]
    rows += [(50, "twice", "same", None), (50, "twice", "same", None), (None, "no id", "<i>x</i>", None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("segment", [100, 64 * 1024])
def test_round_trip(spark, pages, segment):
    folder = write_archives(pages, segment_bytes=segment, file_bytes=50_000)
    got = read_archives(spark, folder).collect()
    source = [tuple(r) for r in pages.collect()]
    assert len(got) == len(source) and not [r for r in got if r["error"]]
    first = {}
    for page, _, html, _ in source:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    html_of = {page: html or "" for page, _, html, _ in source}
    for row in got:
        html = html_of[row["page_id"]]
        assert (row["payload_bytes"], row["payload_digest"]) == (len(html.encode()), digest(html))
        repeats = row["page_id"] is not None and row["page_id"] > first[html]
        assert row["record_type"] == ("revisit" if repeats else "response")
        assert row["refers_to"] == (first[html] if repeats else None)
        assert row["payload"] == (None if repeats else html.encode())
    names = read_records(spark, folder).where("segment > 1").count()
    assert (names > 0) == (segment == 100 or names > 0)


def test_payloads_shorter_than_the_limit_do_not_revisit(spark, pages):
    folder = write_archives(pages, least_bytes=1_000_000)
    assert read_archives(spark, folder).where("record_type = 'revisit'").count() == 0


def test_chunked_framing():
    for body in (b"", b"x", b"y" * 30_000):
        assert dechunked(chunked(body)) == body
    assert dechunked(b"3;name=v\r\nabc\r\n0\r\nTrailer: t\r\n\r\n") == b"abc"
    for broken in (b"", b"5\r\nabc", b"zz\r\nabc\r\n0\r\n\r\n", b"3\r\nabcX0\r\n\r\n", b"-1\r\n\r\n"):
        with pytest.raises(ValueError):
            dechunked(broken)


def test_parsing_plain_and_compressed_archives():
    data = b"".join(record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{i}>")], b"b\r\n\r\n" * i) for i in range(9))
    for source in (data, gzip.compress(data), b"".join(gzip.compress(data[i : i + 50]) for i in range(0, len(data), 50))):
        found = list(parse_records(io.BytesIO(source)))
        assert [b for _, b in found] == [b"b\r\n\r\n" * i for i in range(9)]
    with pytest.raises(ValueError):
        list(parse_records(io.BytesIO(data[:-40])))


def test_segments_of_several_files_and_damage(spark, tmp_path):
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"

    def parts(name, body, total, drop=None, want=None):
        cut = [body[i : i + 7] for i in range(0, len(body), 7)]
        for number, part in enumerate(cut, 1):
            fields = [("WARC-Record-ID", f"<{name}{number}>"), ("WARC-Segment-Number", number)]
            if number == 1:
                fields[0] = ("WARC-Record-ID", f"<{name}>")
                fields += [("WARC-Type", "response"), ("WARC-Page-ID", len(name)), ("WARC-Target-URI", name)]
                fields += [("WARC-Payload-Digest", f"sha1:{want}")] if want else []
            else:
                fields += [("WARC-Type", "continuation"), ("WARC-Segment-Origin-ID", f"<{name}>")]
            if number == len(cut):
                fields.append(("WARC-Segment-Total-Length", total))
            if number != drop:
                yield record(fields, part)

    good = head + chunked(b"the payload")
    records = [
        *parts("good", good, len(good), want=digest("the payload")),
        *parts("gap", good, len(good), drop=3),
        *parts("no end", good, len(good), drop=-(-len(good) // 7)),
        *parts("length", good, len(good) + 1),
        *parts("chunks", head + b"5\r\nabc", len(head) + 6),
        *parts("digest", good, len(good), want=digest("another")),
        *parts("no first", good, len(good), drop=1),
    ]
    # Segments come in any order and from any file.
    for i in range(3):
        (tmp_path / f"f{i}.warc").write_bytes(b"".join(records[i::3][::-1]))
    spark.createDataFrame([(str(tmp_path / f"f{i}.warc"),) for i in range(3)], "path string").write.parquet(
        f"{tmp_path}/files.parquet"
    )
    errors = {r["url"]: (r["error"], r["payload"]) for r in read_archives(spark, str(tmp_path)).collect()}
    assert errors["good"] == (None, b"the payload")
    assert {n: e for n, (e, _) in errors.items() if n != "good"} == {
        "gap": MISSING, "no end": MISSING, "length": WRONG_LENGTH, "chunks": BAD_CHUNKS,
        "digest": WRONG_DIGEST, None: MISSING,
    }


def test_empty_table(spark, pages):
    folder = write_archives(pages.where(F.lit(False)))
    assert read_archives(spark, folder).count() == 0
    assert filesystem("file:/tmp/x")[1] == filesystem("file:///tmp/x")[1] == filesystem("/tmp/x")[1] == "/tmp/x"


def test_a_damaged_archive_gives_its_sound_records_and_a_row(spark, tmp_path):
    def plain(i, fields=()):
        body = b"HTTP/1.1 200 OK\r\n\r\n" + b"page %d " % i * 50
        return record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{i}>"), ("WARC-Page-ID", i), *fields], body)

    whole = [gzip.compress(plain(i)) for i in range(4)]
    nameless = record([("WARC-Type", "response"), ("WARC-Page-ID", "20")], b"HTTP/1.1 200 OK\r\n\r\nx")
    files = {
        "cut.warc.gz": b"".join(whole)[:-30],
        "bits.warc.gz": whole[0] + whole[1][:40] + b"\xff" * 40,
        "length.warc": plain(10) + b"WARC/1.0\r\nWARC-Type: response\r\n\r\nabc",
        "nameless.warc": nameless + plain(21),
        "good.warc.gz": gzip.compress(plain(30)),
        "empty.warc.gz": b"",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    spark.createDataFrame([(str(tmp_path / n),) for n in files], "path string").write.parquet(f"{tmp_path}/files.parquet")
    found = read_archives(spark, str(tmp_path)).collect()
    assert sorted(r.page_id for r in found if r.error is None) == [0, 0, 1, 2, 10, 20, 21, 30]
    damaged = [r for r in found if r.error is not None]
    assert {r.record_type for r in damaged} == {"damaged"} and {r.page_id for r in damaged} == {None}
    assert sorted(r.error.split(":")[0].rsplit("/", 1)[1] for r in damaged) == ["bits.warc.gz", "cut.warc.gz", "length.warc"]


def test_one_large_record_and_blank_lines():
    big = record([("WARC-Type", "resource"), ("WARC-Record-ID", "<big>")], b"x" * 30_000_000)
    found = list(parse_records(io.BytesIO(b"\r\n" * 40_000 + big + b"\r\n" * 40_000 + big)))
    assert [len(b) for _, b in found] == [30_000_000] * 2


def test_folders_are_resolved_as_spark_does(spark, tmp_path):
    assert shared_folder(spark, str(tmp_path)) == f"file:{tmp_path}"
    for unknown in ("wasb://a@b/c", "ftp://host/x"):
        with pytest.raises(ValueError):
            filesystem(unknown)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://other/")
    conf.set("fs.viewfs.mounttable.other.link./in", f"file://{tmp_path}")
    try:
        assert shared_folder(spark, "/in/a").startswith("viewfs://other/in/a")
    finally:
        conf.set("fs.defaultFS", before)
