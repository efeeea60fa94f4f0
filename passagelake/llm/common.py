"""What the operators share: reading tables, mapping Arrow batches, writing shared files."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable, Iterator
from types import ModuleType

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from passagelake.sources.corpus import spread_small_input

SLICE_CHARS = 2_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread_small_input(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def crc32_remainder(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def map_rows(
    df: DataFrame,
    rows: Callable[[Iterator[dict]], Iterator[dict]],
    schema: str,
    slice_chars: int = SLICE_CHARS,
) -> DataFrame:
    """``mapInArrow`` over columns: ``rows`` takes and gives dictionaries of lists.

    Batches are cut so that one holds about ``slice_chars`` of text (or a single row).
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def slices(batches):
        for batch in batches:
            weights = [0] * batch.num_rows
            for column in batch.columns:
                if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                    lengths = pa.compute.binary_length(column).fill_null(0).to_pylist()
                    weights = [a + b for a, b in zip(weights, lengths)]
            start, held = 0, 0
            for i, weight in enumerate(weights):
                held += weight
                if held >= slice_chars:
                    yield batch.slice(start, i + 1 - start).to_pydict()
                    start, held = i + 1, 0
            if start < batch.num_rows:
                yield batch.slice(start).to_pydict()

    def run(batches):
        for columns in rows(slices(batches)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow
            )

    return df.mapInArrow(run, schema)


def kept_in_worker(key: object, build: Callable[[], object]) -> object:
    """What ``build`` gives, made once in each Python worker and kept for its later tasks.

    For tokenizers and the like. Functions are shipped to the tasks by value, so their
    own module's variables would not last; the object is kept beside them.
    """
    name = "_kept_in_worker"
    kept = sys.modules.setdefault(name, ModuleType(name)).__dict__
    if key not in kept:
        kept[key] = build()
    return kept[key]


#: Schemes that Spark reads, by the names that the tasks' file systems have for them.
SCHEMES = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "gs": "gs", "gcs": "gs",
           "abfs": "abfs", "abfss": "abfss"}


def shared_folder(spark: SparkSession, folder: str) -> str:
    """A folder with its scheme, as Spark resolves it: without one it lies in the default file system.

    A scheme that the tasks can not open is an error, before anything is written.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.makeQualified(path).toString()
    scheme(found)
    return found


def scheme(folder: str) -> str:
    name = folder.partition(":")[0] if ":" in folder.partition("/")[0] else ""
    if name and name not in SCHEMES:
        raise ValueError(f"tasks can not open folders of the scheme {name!r}; known are {sorted(SCHEMES)}")
    return name


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that ``shared_folder`` gave, by its scheme, and the path on it."""
    name = scheme(folder)
    if not name:
        return pafs.LocalFileSystem(), os.path.abspath(folder)
    if name == "file":
        return pafs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return pafs.FileSystem.from_uri(SCHEMES[name] + folder[len(name) :])


def publish_file(files: pafs.FileSystem, temporary: str, path: str) -> None:
    """Rename a finished file into place: a second attempt of a task writes the same one."""
    files.move(temporary, path)
