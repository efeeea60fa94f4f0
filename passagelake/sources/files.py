"""Files that tasks open themselves, on whatever file system Spark resolves their folder to."""

from __future__ import annotations

import os

from pyarrow import fs as pafs
from pyspark.sql import SparkSession

# Schemes that Spark reads, by the names that the tasks' file systems have for them.
SCHEMES = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "gs": "gs", "gcs": "gs",
           "abfs": "abfs", "abfss": "abfss"}


def scheme(folder: str) -> str:
    """The scheme of a folder's or file's address, '' for none; one that tasks can not open is an error."""
    name = folder.partition(":")[0] if ":" in folder.partition("/")[0] else ""
    if name and name not in SCHEMES:
        raise ValueError(f"tasks can not open folders of the scheme {name!r}; known are {sorted(SCHEMES)}")
    return name


def shared_folder(spark: SparkSession, folder: str) -> str:
    """A folder with its scheme, as Spark resolves it: without one it lies in the default file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.makeQualified(path).toString()
    scheme(found)
    return found


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that ``shared_folder`` gave, by its scheme, and the path on it."""
    name = scheme(folder)
    if not name:
        return pafs.LocalFileSystem(), os.path.abspath(folder)
    if name == "file":
        return pafs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return pafs.FileSystem.from_uri(SCHEMES[name] + folder[len(name) :])
