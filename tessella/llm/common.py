"""Shared folder, written tables, and file access for the training-data operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import ship_package


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only where the session names none (tests on one machine), a temporary folder is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = jvm_dir.get() if jvm_dir.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessella-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def prepare(spark: SparkSession) -> None:
    """For operators that run Python on the executors: send the package, keep Arrow batches small."""
    ship_package(spark)


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; nothing is created yet."""
    prepare(spark)
    return f"{shared_root(spark)}/tessella/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends there."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Written tables that one call of an operator makes, and that it can drop when done."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths = spark, label, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = new_folder(self.spark, f"{self.label}-{name}")
        self.paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for path in self.paths:
            remove(self.spark, path)
        self.paths = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than rows + 1 of them."""
    return df.limit(rows + 1).count() <= rows


def join_checked(left: DataFrame, right: DataFrame, on, how: str, rows: int) -> DataFrame:
    """Join that broadcasts right only when it is counted to have at most `rows` rows."""
    return left.join(F.broadcast(right) if small(right, rows) else right, on, how)


# ---- memory of workers ---------------------------------------------------------------------
# A worker serves the tasks of one operator after another's; what the earlier one has cached counts
# against the executor's memory.
_HELD: list = []


def hold(drop) -> None:
    """Register how a cache that outlives its task is emptied."""
    _HELD.append(drop)


def release() -> None:
    """Empty the caches that earlier tasks have left in this worker, and give free memory back to the system."""
    while _HELD:
        _HELD.pop()()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library's
    if trim:
        trim(0)


# ---- files of our own formats -------------------------------------------------------------
# Executors reach the shared folder as a mounted path (file: or no scheme) or, for another
# scheme, through Arrow's file systems.


def _local(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def open_read(uri: str):
    """A seekable binary file."""
    if (path := _local(uri)) is not None:
        return open(path, "rb")
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


class atomic_output:
    """Context manager: bytes go to a name of this attempt's own and appear under `uri` when complete.

    Readers never see half a file. A task that runs twice replaces its file, so either the second one
    must be equal, or its name must be the attempt's own and go out with the task's rows.
    """

    def __init__(self, uri: str):
        self.uri, self.token = uri, uuid.uuid4().hex

    def __enter__(self):
        if (path := _local(self.uri)) is not None:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            self.system, self.path = None, path
            self.part = f"{path}.{self.token}.part"
            self.file = open(self.part, "wb")
        else:
            from pyarrow import fs

            self.system, self.path = fs.FileSystem.from_uri(self.uri)
            self.part = f"{self.path}.{self.token}.part"
            self.system.create_dir(os.path.dirname(self.path), recursive=True)
            self.file = self.system.open_output_stream(self.part)
        return self.file

    def __exit__(self, kind, *_):
        self.file.close()
        if self.system is None:
            os.unlink(self.part) if kind else os.replace(self.part, self.path)
        elif kind:
            self.system.delete_file(self.part)
        else:
            self.system.move(self.part, self.path)
