"""WARC archives: pages written as segmented records, read back and reassembled.

A page is a ``response`` record: an HTTP answer in chunked transfer coding. Blocks
over SEGMENT_BYTES are cut: the first record keeps its type and has segment number
1, the others are ``continuation`` records with the first one's id as their origin;
the last says the total length. A page whose payload was stored before is a
``revisit`` record without payload. Files are gzip, a member per record, rolled at
about FILE_BYTES.

Reading: one task per file yields the records; segments are grouped by their
origin, ordered by number, checked for gaps and against the total length, then the
transfer coding is undone and the digest is compared.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from passagelake.llm.common import filesystem, map_rows, publish_file, shared_folder
from passagelake.session import scratch_folder

SEGMENT_BYTES = 64 * 1024
CHUNK_BYTES = 8 * 1024
FILE_BYTES = 32 * 1024 * 1024
READ_BYTES = 1024 * 1024
VERSION = b"WARC/1.1\r\n"
EPOCH = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MISSING = "Segments missing"
WRONG_LENGTH = "Length differs from the total"
BAD_CHUNKS = "Broken transfer coding"
WRONG_DIGEST = "Digest differs"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts.append(b"%x\r\n%s\r\n" % (len(part), part))
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """Undo chunked transfer coding; extensions and trailers are skipped. ValueError if broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0].strip(), 16)
        if size < 0:
            raise ValueError("negative chunk size")
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk does not end where it says")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """Payload of an HTTP answer. ValueError if its head or its framing is broken."""
    end = block.index(b"\r\n\r\n")
    body = block[end + 4 :]
    for line in block[:end].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"transfer-encoding" and b"chunked" in value.lower():
            return dechunked(body)
    return body


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return VERSION + f"{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _header(value: object) -> str:
    """A header value on one line."""
    return " ".join(str("" if value is None else value).split())


def page_records(name: str, page_id, url, payload: bytes, refers_to, revisit: bool, segment: int):
    """The records of a page. ``name`` is unique among all pages written."""
    first = f"<urn:passagelake:{name}>"
    common = [
        ("WARC-Date", EPOCH),
        ("WARC-Target-URI", _header(url)),
        ("WARC-Page-ID", _header(page_id)),
        ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
        ("WARC-Payload-Length", len(payload)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if revisit:
        more = [("WARC-Profile", PROFILE), ("WARC-Refers-To-Page-ID", refers_to)]
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", first), *common, *more], head)
        return
    block = head + chunked(payload)
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    if len(parts) == 1:
        yield record([("WARC-Type", "response"), ("WARC-Record-ID", first), *common], block)
        return
    for number, part in enumerate(parts, 1):
        if number == 1:
            fields = [("WARC-Type", "response"), ("WARC-Record-ID", first), *common]
        else:
            fields = [
                ("WARC-Type", "continuation"),
                ("WARC-Record-ID", f"<urn:passagelake:{name}:{number}>"),
                ("WARC-Date", EPOCH),
                ("WARC-Segment-Origin-ID", first),
            ]
        fields.append(("WARC-Segment-Number", number))
        if number == len(parts):
            fields.append(("WARC-Segment-Total-Length", len(block)))
        yield record(fields, part)


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages with payload, and ``refers_to``: the smallest page_id with an equal payload, else null.

    Only digests held by several pages are joined back. A page refers to another
    id than its own: rows that repeat the smallest id are all responses, and rows
    without id too.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    digested = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    long_enough = digested.where(F.length("payload") >= least_bytes)
    repeated = long_enough.groupBy("digest").agg(
        F.min("page_id").alias("first_page"), F.max("page_id").alias("last_page")
    )
    repeated = repeated.where("first_page < last_page").select("digest", "first_page")
    other = F.col("first_page") < F.col("page_id")
    return digested.join(repeated, "digest", "left").select(
        "page_id", "url", "payload", F.when(other, F.col("first_page")).alias("refers_to")
    )


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    least_bytes: int = 0,
    segment_bytes: int = SEGMENT_BYTES,
    file_bytes: int = FILE_BYTES,
) -> str:
    """Write a record (or its segments) per row of (page_id, url, html); returns the folder.

    Every task writes its own files, names them by its partition and moves them into
    place when they are whole, so a task that runs again replaces them. ``files.parquet``
    lists the files. Null html is an empty payload; null urls and ids are empty fields.
    """
    spark = pages.sparkSession
    folder = shared_folder(spark, folder or scratch_folder(spark, "warc"))
    files, path = filesystem(folder)
    files.create_dir(path, recursive=True)

    def write(slices):
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        files, path = filesystem(folder)
        out, place, done = None, None, 0
        number = 0
        for rows in slices:
            for page, url, payload, refers in zip(
                rows["page_id"], rows["url"], rows["payload"], rows["refers_to"]
            ):
                records = page_records(
                    f"{part}-{number}", page, url, payload, refers, refers is not None, segment_bytes
                )
                number += 1
                for data in records:
                    if out is None:
                        place = f"{path}/pages-{part:06d}-{done:04d}.warc.gz"
                        out = files.open_output_stream(f"{place}.{attempt}", compression=None)
                    out.write(gzip.compress(data, 1, mtime=0))
                    if out.tell() >= file_bytes:
                        out.close()
                        publish_file(files, f"{place}.{attempt}", place)
                        yield {"path": [place]}
                        out, done = None, done + 1
        if out is not None:
            out.close()
            publish_file(files, f"{place}.{attempt}", place)
            yield {"path": [place]}

    map_rows(mark_revisits(pages, least_bytes), write, "path string").write.mode("overwrite").parquet(
        f"{folder}/files.parquet"
    )
    return folder


def inflate(stream, size: int = READ_BYTES):
    """Pieces of the text of a gzip file with any number of members; plain files pass."""
    data = stream.read(size)
    if data[:2] != b"\x1f\x8b":
        while data:
            yield data
            data = stream.read(size)
        return
    unpack = zlib.decompressobj(31)
    while data:
        piece = unpack.decompress(data)
        if piece:
            yield piece
        if unpack.eof:
            data = unpack.unused_data or stream.read(size)
            unpack = zlib.decompressobj(31)
        else:
            data = stream.read(size)


def parse_records(stream):
    """(fields, block) of each record; field names in lower case. Holds one record at a time.

    ValueError or zlib.error where an archive is damaged: what stands behind can not be found.
    """
    pieces, held = inflate(stream), bytearray()

    def fill() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while True:
        looked = 0
        while True:
            if held[:1] in (b"\r", b"\n"):
                held[:] = held.lstrip(b"\r\n")
                looked = 0
            end = held.find(b"\r\n\r\n", max(0, looked - 3))
            if end >= 0:
                break
            looked = len(held)
            if not fill():
                if held.strip():
                    raise ValueError("archive ends inside a record's head")
                return
        fields = {}
        for line in held[:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        if not fields.get("content-length", "").isdigit():
            raise ValueError("record without a length")
        size = int(fields["content-length"])
        del held[: end + 4]
        while len(held) < size:
            if not fill():
                raise ValueError("archive ends inside a record's block")
        yield fields, bytes(held[:size])
        del held[:size]


#: Stands for the type of what could not be read.
DAMAGED = "damaged"
PAGE = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
    "payload_digest string, payload binary, error string"
)
RAW = (
    "origin string, segment int, total bigint, record_type string, page_id bigint, url string, "
    "refers_to bigint, payload_bytes bigint, payload_digest string, block binary, damage string"
)


def read_records(
    spark: SparkSession, folder: str, list_name: str = "files.parquet", segments: bool | None = None
) -> DataFrame:
    """Raw records of all archives, one row per record or segment, see RAW.

    ``segments`` True gives only the parts of segmented records, False only whole ones.
    An archive that is damaged gives the records before the place, and a row of type
    "damaged" whose ``damage`` says what is wrong (not among the segments).
    """
    folder = shared_folder(spark, folder)
    paths = spark.read.parquet(f"{folder}/{list_name}").select("path")
    count = max(1, paths.count())

    names = [part.split()[0] for part in RAW.split(", ")]

    def number(value):
        return int(value) if value and value.isdigit() else None

    def records(files, path):
        """Rows of an archive as tuples."""
        with files.open_input_stream(path, compression=None) as stream:
            try:
                for place, (fields, block) in enumerate(parse_records(stream)):
                    if segments is not None and segments != ("warc-segment-number" in fields):
                        continue
                    yield (
                        fields.get("warc-segment-origin-id") or fields.get("warc-record-id") or f"{path}#{place}",
                        number(fields.get("warc-segment-number")) or 0,
                        number(fields.get("warc-segment-total-length")),
                        fields.get("warc-type"),
                        number(fields.get("warc-page-id")),
                        fields.get("warc-target-uri"),
                        number(fields.get("warc-refers-to-page-id")),
                        number(fields.get("warc-payload-length")),
                        (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
                        block,
                        None,
                    )
            except (ValueError, zlib.error) as damage:
                if segments is not True:
                    yield (path, 0, None, DAMAGED, None, None, None, None, None, b"", f"{path}: {damage}")

    def read(slices):
        files, _ = filesystem(folder)
        out, held = {n: [] for n in names}, 0
        for rows in slices:
            for path in rows["path"]:
                for row in records(files, path):
                    for name, value in zip(names, row):
                        out[name].append(value)
                    held += len(row[names.index("block")])
                    if held > 4 * READ_BYTES:
                        yield out
                        out, held = {n: [] for n in names}, 0
        if out["origin"]:
            yield out

    return map_rows(paths.repartition(min(count, 10_000), "path"), read, RAW)


def _finished(rows: dict, keep_payload: bool) -> dict:
    """Decoded pages of whole blocks; what is wrong with a page stands in ``error``."""
    out = {n: rows[n] for n in ("page_id", "url", "record_type", "refers_to")}
    sizes, digests, payloads, errors = [], [], [], []
    for kind, blocks, total, size, digest, error in zip(
        *(rows[n] for n in ("record_type", "blocks", "total", "payload_bytes", "payload_digest", "error"))
    ):
        payload, block = None, b"".join(blocks)
        if error is None and total is not None and len(block) != total:
            error = WRONG_LENGTH
        if error is None and kind != "revisit":
            try:
                payload = http_payload(block)
            except ValueError:
                error = BAD_CHUNKS
            else:
                size, found = len(payload), digest_of(payload)
                error = WRONG_DIGEST if digest is not None and found != digest else None
                digest = found
        sizes.append(size)
        digests.append(digest)
        payloads.append(payload if keep_payload else None)
        errors.append(error)
    return out | {
        "payload_bytes": sizes, "payload_digest": digests, "payload": payloads, "error": errors
    }


def read_archives(
    spark: SparkSession, folder: str, keep_payload: bool = True, list_name: str = "files.parquet"
) -> DataFrame:
    """Pages of the archives, segments put together; see PAGE.

    Only segments are shuffled, by their origin: a group is one page. A revisit has
    the length and digest of the payload it refers to, and no payload itself. What is
    wrong with a page stands in ``error``; an archive that breaks off gives its records
    before that place and a row of type "damaged" without a page.
    """
    columns = [
        "record_type", "page_id", "url", "refers_to", "payload_bytes", "payload_digest", "blocks", "total", "error"
    ]
    whole = (
        read_records(spark, folder, list_name, segments=False)
        .withColumn("blocks", F.array("block"))
        .withColumn("error", F.col("damage"))
    )
    parts = F.array_sort(F.collect_list(F.struct("segment", "block", "total")))
    first = F.col("segment") == 1
    one = [
        F.max(F.when(first, F.col(name))).alias(name)
        for name in ("record_type", "page_id", "url", "refers_to", "payload_bytes", "payload_digest")
    ]
    grouped = (
        read_records(spark, folder, list_name, segments=True)
        .groupBy("origin")
        .agg(parts.alias("parts"), *one)
        .withColumn("total", F.col("parts")[F.size("parts") - 1]["total"])
        .withColumn("blocks", F.col("parts.block"))
    )
    complete = (F.col("parts.segment") == F.sequence(F.lit(1), F.size("parts"))) & F.col("total").isNotNull()
    grouped = grouped.withColumn("error", F.when(~F.coalesce(complete, F.lit(False)), MISSING))
    records = whole.select(columns).unionByName(grouped.select(columns))
    return map_rows(records, lambda slices: (_finished(rows, keep_payload) for rows in slices), PAGE)
