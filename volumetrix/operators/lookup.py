"""Point lookups, counts and paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import exists


def find_by_index(files: DataFrame, index: int, volume: str | None = None) -> DataFrame:
    rows = files.where(F.col("mft_index") == index)
    return rows if volume is None else rows.where(F.col("volume") == volume)


def find_by_name(files: DataFrame, name: str) -> DataFrame:
    """The lowest record number with exactly this name."""
    return files.where(F.col("name") == name).orderBy("mft_index").limit(1)


def count_files(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("n_files"))


def count_slots(files: DataFrame, loaded_slots: int | None = None) -> DataFrame:
    """Slots including empty ones: creates grow the table, deletes never shrink it."""
    top = F.coalesce(F.max("mft_index") + 1, F.lit(0))
    return files.agg((top if loaded_slots is None else F.greatest(top, F.lit(loaded_slots))).cast("long").alias("n_slots"))


def page(results: DataFrame, offset: int, limit: int) -> DataFrame:
    return results.orderBy("mft_index").offset(offset).limit(limit)


def list_volumes(spark: SparkSession, configured: dict[str, str]) -> DataFrame:
    """volume (upper-case letter) and path of the configured volumes that are there, in letter order: one look per letter, on the driver."""
    there = [(letter.upper(), path) for letter, path in sorted(configured.items(), key=lambda x: x[0].upper()) if exists(spark, path)]
    return spark.createDataFrame(there, "volume string, path string").orderBy("volume")


def first_volume(volumes: DataFrame) -> DataFrame:
    return volumes.orderBy("volume").limit(1)


def total_run_bytes(runs: DataFrame) -> DataFrame:
    return runs.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).cast("long").alias("n_bytes"))
