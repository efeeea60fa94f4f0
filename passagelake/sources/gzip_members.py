"""Gzip files of several members: written as such, indexed, and read by several tasks.

A gzip file can be a row of members, each compressed by itself. Where they begin is
only known by reading the file once; the index keeps it, with each member's lines, and
tells whole files from damaged ones on the way. A reader then deals out runs of members:
a 1 TB file is read by as many tasks as it has runs. Files pass through the tasks in
pieces; none is held.
"""

from __future__ import annotations

import codecs
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from passagelake.functions.text import WHITESPACE
from passagelake.sources.files import filesystem, shared_folder

#: Text of a member that is written, compressed bytes of a run that a task reads.
MEMBER_BYTES = 16 * 1024 * 1024
RUN_BYTES = 32 * 1024 * 1024
PIECE_BYTES = 1024 * 1024
MAX_TASKS = 100_000

MEMBERS = (
    "path string, member int, offset bigint, size bigint, newlines bigint, ends_line boolean, "
    "first_text bigint, whole boolean"
)
LINES = "value string, path string, line_num bigint"


def listed_files(spark: SparkSession, paths: str | list[str], pattern: str = "*.gz") -> DataFrame:
    """(path, size) of the files below folders, from their listing alone."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return reader.load(paths).select("path", F.col("length").alias("size"))


def _inflated(stream, piece: int = PIECE_BYTES):
    """(text, compressed bytes taken, whether a member ended) in pieces; zlib.error and EOFError for damage.

    Bytes that are taken belong to the member that the text does.
    """
    data, unpack = b"", zlib.decompressobj(31)
    while True:
        if not data:
            data = stream.read(piece)
            if not data:
                if unpack is not None:
                    raise EOFError("the file ends inside a member")
                return
        if unpack is None:
            unpack = zlib.decompressobj(31)
        text = unpack.decompress(data, piece)
        rest = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
        yield text, len(data) - len(rest), unpack.eof
        data = bytes(rest)
        if unpack.eof:
            unpack = None


def is_damaged(path: str) -> bool:
    """Whether a file is not whole, read through in pieces; one that is gone by now is not."""
    system, place = filesystem(path)
    try:
        with system.open_input_stream(place, compression=None) as stream:
            for _ in _inflated(stream):
                pass
    except (zlib.error, EOFError):
        return True
    except FileNotFoundError:
        return False
    return False


class _FirstText:
    """The place of the first line with anything but white space in it; None for none."""

    def __init__(self):
        self.decoder, self.line, self.found = codecs.getincrementaldecoder("utf-8")("replace"), 0, None

    def add(self, text: bytes) -> None:
        if self.found is None:
            lines = self.decoder.decode(text).split("\n")
            for at, line in enumerate(lines):
                if line.strip(WHITESPACE):
                    self.found = self.line + at
                    return
            self.line += len(lines) - 1


def index_members(files: DataFrame) -> DataFrame:
    """Rows of MEMBERS for the files of ``path``, each read once, by one task.

    ``newlines`` counts those in the member, ``ends_line`` says whether its last byte is one,
    ``first_text`` is the place of the file's first line that is not blank. A damaged
    file's last row is not ``whole``. (Spark does not list files without a byte.)
    """

    def read(batches):
        names = [f.split()[0] for f in MEMBERS.split(", ")]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, first, offset = [], _FirstText(), 0
                system, place = filesystem(path)
                size = newlines = 0
                last = b"\n"
                try:
                    with system.open_input_stream(place, compression=None) as stream:
                        for text, taken, ended in _inflated(stream):
                            first.add(text)
                            size, newlines, last = size + taken, newlines + text.count(b"\n"), text[-1:] or last
                            if ended:
                                rows.append((path, len(rows), offset, size, newlines, last == b"\n", True))
                                offset, size, newlines = offset + size, 0, 0
                except (zlib.error, EOFError):
                    rows.append((path, len(rows), offset, size, newlines, last == b"\n", False))
                columns = list(zip(*[(*r[:6], first.found, r[6]) for r in rows]))
                types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    paths = files.select("path")
    return paths.repartition(max(1, min(paths.count(), MAX_TASKS)), "path").mapInArrow(read, MEMBERS)


def member_runs(members: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Runs of neighbouring members of the whole files, about ``run_bytes`` long.

    (path, offset, size, before, inside, open_end, first_text): ``before`` counts the lines that end
    before the run; ``inside`` says that it begins inside a line, ``open_end`` that it ends in one.
    """
    file = Window.partitionBy("path")
    earlier = file.orderBy("member").rowsBetween(Window.unboundedPreceding, -1)
    placed = members.withColumns(
        {
            "_whole": F.min("whole").over(file),
            "_before": F.coalesce(F.sum("newlines").over(earlier), F.lit(0)),
            "_inside": ~F.coalesce(F.lag("ends_line").over(file.orderBy("member")), F.lit(True)),
            "_last": F.max("member").over(file) == F.col("member"),
            "_run": F.floor(F.col("offset") / run_bytes),
        }
    ).where("_whole")
    open_end = ~F.col("ends_line") & ~F.col("_last")
    return placed.groupBy("path", "_run").agg(
        F.min("offset").alias("offset"),
        F.sum("size").alias("size"),
        F.min("_before").alias("before"),
        F.min_by("_inside", "member").alias("inside"),
        F.max_by(open_end, "member").alias("open_end"),
        F.first("first_text").alias("first_text"),
    ).drop("_run")


def read_runs(runs: DataFrame) -> DataFrame:
    """The lines of runs: value, path, line_num, which counts from the file's first line that is not blank.

    A line that crosses the end of a run belongs to the run in which it begins, whose task
    reads on for it. Bytes that are no UTF-8 are replaced.
    """

    def lines_of(path, offset, size, before, inside, open_end):
        """(first line's place, whole lines as one piece of text) again and again."""
        system, place = filesystem(path)
        held, number, skipping = [], before, inside
        with system.open_input_file(place) as file:
            file.seek(offset)
            taken = 0
            for text, used, _ in _inflated(file):
                beyond = taken >= size
                taken += used
                if skipping:
                    cut = text.find(b"\n")
                    if beyond:
                        return  # the run lies inside one line
                    if cut < 0:
                        continue
                    text, skipping, number = text[cut + 1 :], False, number + 1
                if beyond:
                    cut = text.find(b"\n")
                    held.append(text if cut < 0 else text[:cut])
                    if cut >= 0:
                        break
                    continue
                cut = text.rfind(b"\n")
                if cut >= 0:
                    whole = b"".join([*held, text[: cut + 1]])
                    yield number, whole
                    number += whole.count(b"\n")
                    held = [text[cut + 1 :]] if cut + 1 < len(text) else []
                elif text:
                    held.append(text)
                if taken >= size and not open_end:
                    break
        if not skipping and (rest := b"".join(held)):
            yield number, rest + b"\n"

    def read(batches):
        for batch in batches:
            for run in batch.to_pylist():
                first = run["first_text"] or 0
                keys = ("path", "offset", "size", "before", "inside", "open_end")
                for number, text in lines_of(*(run[k] for k in keys)):
                    values = text[:-1].decode("utf-8", "replace").split("\n")
                    places = range(number - first, number - first + len(values))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(values, pa.string()), pa.array([run["path"]] * len(values), pa.string()), pa.array(places, pa.int64())],
                        names=["value", "path", "line_num"],
                    )

    count = max(1, min(runs.count(), MAX_TASKS))
    return runs.repartition(count, "path", "offset").mapInArrow(read, LINES)


def write_members(lines: DataFrame, folder: str, member_bytes: int = MEMBER_BYTES, level: int = 6) -> str:
    """Write the lines of ``value`` as gzip files of several members, a file per task; returns the folder.

    Rows keep their order inside a task. A member ends with a line, after about
    ``member_bytes`` of text. A task that runs again replaces its file.
    """
    spark = lines.sparkSession
    folder = shared_folder(spark, folder)

    def write(batches):
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        system, place = filesystem(folder)
        system.create_dir(place, recursive=True)
        name, out, pack, held = f"{place}/part-{part:06d}.jsonl.gz", None, None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                values = [v for v in batch.column("value").slice(at, 1000).to_pylist() if v is not None]
                for value in values:
                    if out is None:
                        out = system.open_output_stream(f"{name}.{attempt}", compression=None)
                    pack = pack or zlib.compressobj(level, wbits=31)
                    text = value.encode() + b"\n"
                    out.write(pack.compress(text))
                    held += len(text)
                    if held >= member_bytes:
                        out.write(pack.flush())
                        pack, held = None, 0
        if out is not None:
            if pack is not None:
                out.write(pack.flush())
            out.close()
            system.move(f"{name}.{attempt}", name)
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["file"])

    lines.select("value").mapInArrow(write, "file string").write.format("noop").mode("overwrite").save()
    return folder
