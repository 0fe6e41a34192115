"""The shared folder, tables written in between, and small files read or written through Hadoop's own streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only on a single machine that names none."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="volumetrix-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/vx-{label}-{uuid.uuid4().hex}"
    fs, target = hadoop(spark, path)
    fs.deleteOnExit(target)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: lineage is cut, the size is known, and nothing stays cached."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system for a path, and the path as it knows it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = hadoop(spark, path)
    return fs.exists(target)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it is missing."""
    fs, target = hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target) if s.isDirectory()) if fs.exists(target) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, target = hadoop(spark, path)
    fs.delete(target, True)


def read_bytes(spark: SparkSession, path: str, at: int, size: int) -> bytes:
    """A small range of a file, on the driver."""
    fs, target = hadoop(spark, path)
    stream = fs.open(target)
    try:
        stream.seek(at)
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size))
    finally:
        stream.close()
