"""A topic as a data source: numbered entries, read as a batch or as a stream with offsets.

Folders of JSON lines (``topics``) tell a reader which files there are, and no more. Here each sender
numbers what it sends, as a log has entries; an offset says how many entries of each
sender have been read, and names the same messages whenever it is asked for. Senders
do not have to agree on an order, so none waits for another.

Layout below the topic::

    segments/<sender>/<number>/   the messages of an entry, as parquet files of bounded length
    log/<sender>/<number>.json    the entry: its files and how many messages are in each
    cursors/<subscription>.json   the offset that a subscription has acknowledged

An entry is published by its log file, which is written last and moved into place. To read,
``spark.read.format("topic_log")`` and ``spark.readStream.format("topic_log")`` after ``register``
give value, sender, entry, position; the last three name a message. Each file is a partition of its own, so no
task reads more than ``SEGMENT_ROWS`` messages.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from passagelake.sources.files import filesystem, shared_folder

NAME = "topic_log"
MESSAGES = "value string, sender string, entry bigint, position bigint"
SEGMENT_ROWS = 50_000
BATCH_ROWS = 1_000

_NAMES = re.compile(r"[A-Za-z0-9_-]+")


def _checked(name: str) -> str:
    if not _NAMES.fullmatch(name):
        raise ValueError(f"{name!r} is no name: letters, digits, - and _ are")
    return name


def _entry_path(sender: str, number: int) -> str:
    return f"log/{sender}/{number:012d}.json"


def _read_json(folder: str, path: str):
    system, place = filesystem(folder)
    try:
        with system.open_input_stream(f"{place}/{path}") as stream:
            return json.loads(stream.read())
    except FileNotFoundError:
        return None


def _write_json(folder: str, path: str, value) -> None:
    """Written beside its place and moved there, so that no reader sees a part of it."""
    system, place = filesystem(folder)
    target = f"{place}/{path}"
    system.create_dir(target.rpartition("/")[0], recursive=True)
    with system.open_output_stream(f"{target}.new") as stream:
        stream.write(json.dumps(value).encode())
    system.move(f"{target}.new", target)


def log_ends(folder: str) -> dict[str, int]:
    """The offset after all entries: for each sender, how many there are from 0 on without a gap."""
    system, place = filesystem(folder)
    found: dict[str, set[int]] = {}
    for info in system.get_file_info(pafs.FileSelector(f"{place}/log", recursive=True, allow_not_found=True)):
        parts = info.path.rsplit("/", 2)
        if info.type == pafs.FileType.File and re.fullmatch(r"\d{12}\.json", parts[2]):
            found.setdefault(parts[1], set()).add(int(parts[2][:12]))
    ends = {}
    for sender, numbers in sorted(found.items()):
        end = 0
        while end in numbers:
            end += 1
        ends[sender] = end
    return ends


def send(messages: DataFrame, topic: str, sender: str = "main", number: int | None = None) -> int:
    """Append the messages of ``value`` as one entry and return its number; null messages are left out.

    Without a number it is the sender's next. With one, such as the number of a micro-batch, sending
    it again changes nothing. A name is for one sender at a time. An entry without messages counts as one.
    """
    spark = messages.sparkSession
    folder, sender = shared_folder(spark, topic), _checked(sender)
    if number is None:
        number = log_ends(folder).get(sender, 0)
    if _read_json(folder, _entry_path(sender, number)) is not None:
        return number
    segment = f"segments/{sender}/{number:012d}"
    kept = messages.select(F.col("value").cast("string").alias("value")).where("value is not null")
    kept.write.mode("overwrite").option("maxRecordsPerFile", SEGMENT_ROWS).parquet(f"{folder}/{segment}")
    # One row per file: the plan of whoever reads the entry, not its messages.
    files = (
        spark.read.schema("value string").parquet(f"{folder}/{segment}")
        .groupBy(F.col("_metadata.file_name").alias("file"))
        .agg(F.count(F.lit(1)).alias("messages"))
        .orderBy("file")
        .collect()
    )
    _write_json(folder, _entry_path(sender, number), [[f"{segment}/{r.file}", r.messages] for r in files])
    return number


@dataclass
class Segment(InputPartition):
    """A file of an entry, where its first message stands, and how many of them are wanted."""

    file: str
    sender: str
    entry: int
    first: int
    messages: int


def _segments(folder: str, start: dict[str, int], end: dict[str, int]) -> Iterator[Segment]:
    """The files between two offsets, by sender, entry and place."""
    for sender in sorted(end):
        for number in range(start.get(sender, 0), end[sender]):
            files = _read_json(folder, _entry_path(sender, number))
            if files is None:
                raise FileNotFoundError(f"entry {number} of {sender} is gone")
            first = 0
            for file, messages in files:
                yield Segment(file, sender, number, first, messages)
                first += messages


def _read_segment(folder: str, part: Segment) -> Iterator[pa.RecordBatch]:
    system, place = filesystem(folder)
    position, last = part.first, part.first + part.messages
    with system.open_input_file(f"{place}/{part.file}") as file:
        for batch in pq.ParquetFile(file).iter_batches(BATCH_ROWS, columns=["value"]):
            batch = batch.slice(0, last - position)
            count = batch.num_rows
            if not count:
                return
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("value"),
                    pa.array([part.sender] * count, pa.string()),
                    pa.array([part.entry] * count, pa.int64()),
                    pa.array(range(position, position + count), pa.int64()),
                ],
                names=["value", "sender", "entry", "position"],
            )
            position += count


class _BatchReader(DataSourceReader):
    def __init__(self, folder: str, start: dict, end: dict | None, limit: int | None):
        self.folder, self.start, self.end, self.limit = folder, start, end, limit

    def partitions(self):
        end = log_ends(self.folder) if self.end is None else self.end
        parts, left = [], self.limit
        for part in _segments(self.folder, self.start, end):
            if left is not None:
                part.messages = min(part.messages, left)
                left -= part.messages
            if part.messages:
                parts.append(part)
            if left == 0:
                break
        # Spark wants a partition; this one has no messages.
        return parts or [Segment("", "", 0, 0, 0)]

    def read(self, partition):
        return _read_segment(self.folder, partition) if partition.messages else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, folder: str, start: dict, subscription: str | None):
        self.folder, self.start, self.subscription = folder, start, subscription

    def initialOffset(self):
        return self.start

    def latestOffset(self):
        # A sender that is not in the start has been read up to 0.
        return {**self.start, **log_ends(self.folder)}

    def partitions(self, start, end):
        return [part for part in _segments(self.folder, start, end) if part.messages]

    def read(self, partition):
        return _read_segment(self.folder, partition)

    def commit(self, end):
        if self.subscription:
            _acknowledge(self.folder, self.subscription, end)


class TopicLog(DataSource):
    """Options: path; start and end, offsets as JSON; limit, of a batch; subscription, of a stream."""

    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return MESSAGES

    def _offset(self, option: str) -> dict | None:
        text = self.options.get(option)
        return None if text is None else {str(k): int(v) for k, v in json.loads(text).items()}

    def reader(self, schema):
        limit = self.options.get("limit")
        limit = None if limit is None else max(0, int(limit))
        return _BatchReader(self.options["path"], self._offset("start") or {}, self._offset("end"), limit)

    def streamReader(self, schema):
        subscription = self.options.get("subscription")
        return _StreamReader(self.options["path"], self._offset("start") or {}, subscription and _checked(subscription))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TopicLog)


def read_log(
    spark: SparkSession,
    topic: str,
    start: dict[str, int] | None = None,
    end: dict[str, int] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """The messages between two offsets, or the first ``limit`` of them, by sender, entry and position."""
    register(spark)
    reader = spark.read.format(NAME)
    for option, offset in (("start", start), ("end", end)):
        if offset is not None:
            reader = reader.option(option, json.dumps(offset))
    if limit is not None:
        reader = reader.option("limit", limit)
    return reader.load(shared_folder(spark, topic))


def stream_log(
    spark: SparkSession, topic: str, subscription: str | None = None, start: dict[str, int] | None = None
) -> DataFrame:
    """The messages as a stream. What Spark has processed is acknowledged for the subscription.

    Spark acknowledges a batch when it plans the next one, so the cursor may lag behind by one; a stream's own
    place is in its checkpoint. With the trigger ``availableNow`` a run makes one batch of all there is; one that
    follows a run that stopped makes that run's batch again, and the one after it goes on.
    """
    register(spark)
    reader = spark.readStream.format(NAME).option("start", json.dumps(start or {}))
    if subscription:
        reader = reader.option("subscription", _checked(subscription))
    return reader.load(shared_folder(spark, topic))


def _acknowledge(folder: str, subscription: str, offset: dict[str, int]) -> None:
    path = f"cursors/{_checked(subscription)}.json"
    old = _read_json(folder, path) or {}
    new = {sender: max(offset.get(sender, 0), old.get(sender, 0)) for sender in sorted({*offset, *old})}
    if new != old:
        _write_json(folder, path, new)


def acknowledge(spark: SparkSession, topic: str, subscription: str, offset: dict[str, int]) -> None:
    """Move a subscription's cursor on to an offset; it never goes back."""
    _acknowledge(shared_folder(spark, topic), subscription, offset)


def acknowledged(spark: SparkSession, topic: str, subscription: str) -> dict[str, int]:
    """The offset up to which a subscription has acknowledged; {} if it never did."""
    return _read_json(shared_folder(spark, topic), f"cursors/{_checked(subscription)}.json") or {}


def backlog(spark: SparkSession, topic: str, subscriptions: list[str]) -> DataFrame:
    """subscription, total_messages, active_messages: those sent, and those not acknowledged yet.

    Counted from the entries' files on the driver; no message is read.
    """
    folder = shared_folder(spark, topic)
    ends = log_ends(folder)
    cursors = {name: acknowledged(spark, topic, name) for name in subscriptions}
    sent = dict.fromkeys(subscriptions, 0)
    active = dict.fromkeys(subscriptions, 0)
    for part in _segments(folder, {}, ends):
        for name in subscriptions:
            sent[name] += part.messages
            active[name] += part.messages if part.entry >= cursors[name].get(part.sender, 0) else 0
    rows = [(name, sent[name], active[name]) for name in subscriptions]
    return spark.createDataFrame(rows, "subscription string, total_messages bigint, active_messages bigint")
