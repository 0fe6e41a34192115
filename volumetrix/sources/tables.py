"""The driver's star schema read as a file tree, and its events as a change journal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import REASON_FILE_CREATE, REASON_FILE_DELETE, REASON_RENAME_NEW_NAME, REASON_RENAME_OLD_NAME, ROOT

#: Customers with a key divisible by this are left out of the orphaned tree.
ORPHAN_MODULUS = 97


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str, with_orphans: bool = False) -> DataFrame:
    """Root, regions, nations, customers (directories) and orders (files), with disjoint record numbers."""

    def level(name: str, index, parent, label, size=F.lit(0), directory: bool = True, keep=None) -> DataFrame:
        rows = table(spark, sf_dir, name)
        rows = rows if keep is None else rows.where(keep)
        return rows.select(F.lit("C").alias("volume"), index.cast("long").alias("mft_index"), parent.cast("long").alias("parent"), label.alias("name"), size.cast("long").alias("size"), F.lit(directory).alias("is_directory"))

    c = F.col
    root = spark.range(1).select(F.lit("C").alias("volume"), F.lit(ROOT).cast("long").alias("mft_index"), F.lit(ROOT).cast("long").alias("parent"), F.lit(".").alias("name"), F.lit(0).cast("long").alias("size"), F.lit(True).alias("is_directory"))
    order_name = F.concat(F.lit("order_"), c("o_orderkey").cast("string"), F.lit("."), F.substring("o_orderpriority", 1, 1))
    parts = [
        level("region", 100 + c("r_regionkey"), F.lit(ROOT), c("r_name")),
        level("nation", 200 + c("n_nationkey"), 100 + c("n_regionkey"), c("n_name")),
        level("customer", 1_000_000 + c("c_custkey"), 200 + c("c_nationkey"), c("c_name"), keep=c("c_custkey") % ORPHAN_MODULUS != 0 if with_orphans else None),
        level("orders", 10_000_000 + c("o_orderkey"), 1_000_000 + c("o_custkey"), order_name, F.round("o_totalprice"), False),
    ]
    for part in parts:
        root = root.unionByName(part)
    return root


REASONS = {"signup": REASON_FILE_CREATE, "error": REASON_FILE_DELETE, "click": REASON_RENAME_OLD_NAME, "view": REASON_RENAME_NEW_NAME}


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signup creates, error deletes, click and view are a rename's old and new name; purchases say nothing."""
    e = table(spark, sf_dir, "events")
    reason = F.lit(0x80000000)
    for kind, bits in REASONS.items():
        reason = F.when(F.col("event_type") == kind, F.lit(bits)).otherwise(reason)
    name = F.concat(F.lit("n"), F.col("event_id").cast("string"))
    return e.select(F.lit("C").alias("volume"), F.col("event_id").alias("usn"), reason.cast("long").alias("reason"), F.col("user_id").alias("file_ref"), F.lit(ROOT).cast("long").alias("parent_ref"), F.lit(0).cast("long").alias("file_attributes"), name.alias("name"))


def replay_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as typed changes: signup creates, error deletes, purchase renames."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "purchase", "rename")
    return e.select(F.lit("C").alias("volume"), F.col("event_id").alias("usn"), op.alias("op"), F.col("user_id").alias("mft_index"), (1_000_000 + F.col("user_id")).alias("parent"), F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("name"), F.lit(False).alias("is_directory")).where("op is not null")
