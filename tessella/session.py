"""Session settings shared by the tests, the benchmark and the command line."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])

#: Planner settings that hold at any size: adaptive execution merges small and splits skewed
#: shuffle partitions, so the partition count is a ceiling and not a tuning knob.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(name: str, extra: dict[str, str] | None = None, cores: str = "*") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in {**DEFAULTS, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Rows and bytes of an Arrow batch: texts can be long, and a worker holds a batch and what it makes of it.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, and keep their Arrow batches small.

    Nothing is sent where PYTHONPATH already names this repository (workers inherit it).
    """
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    if ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc = spark.sparkContext
    if getattr(sc, "_tessella_shipped", False):
        return
    import shutil
    import tempfile

    folder = tempfile.mkdtemp(prefix="tessella-")
    archive = shutil.make_archive(os.path.join(folder, "tessella"), "zip", ROOT, "tessella")
    sc.addPyFile(archive)
    sc._tessella_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which executors share and whose files survive their loss.

    Only a session on one machine that names no such folder gets a temporary one.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="tessella-checkpoints-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


#: While a table is written: files of what is shuffled go when it is done, and tables that are read are cut into small parts, as compressed ones are small.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.files.maxPartitionBytes": "16m", "spark.sql.files.openCostInBytes": "256k"}
#: Bytes of a part of a file that is read at once, so that files of few tasks are read by many.
GROUP_BYTES = 1 << 20


def write_table(df: DataFrame, path: str) -> None:
    """df as compressed files; what was shuffled to make it is deleted when they are written."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in WRITING}
    try:
        for k, v in WRITING.items():
            conf.set(k, v)
        df.write.option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).parquet(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def kept(df: DataFrame) -> DataFrame:
    """df computed once and kept as compressed files in the shared folder, until `release`.

    A checkpoint takes the space of the rows as they are in memory, and stays as long as the session.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessella-kept-{uuid.uuid4().hex}"
    write_table(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_kept_at"] = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that were `kept` and aren't read any more."""
    for t in tables:
        if path := t.__dict__.get("_kept_at"):
            spark = t.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
