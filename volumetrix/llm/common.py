"""Shared plumbing: reading tables, cutting lineage, joins with a checked broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side counts as small enough to broadcast.
BROADCAST_ROWS = 100_000
#: Texts in an Arrow batch; Spark's default of 10,000 long ones is tens of megabytes on either side, and again as Python strings.
BATCH_ROWS = 2_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; a temporary one only where none is configured."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="volumetrix-")
    sc.setCheckpointDir(own)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialise(df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """Write to the shared folder and read back: lineage is cut and the size is known from then on.

    ``narrow``: rows are a few numbers each, so they are dealt to as many files as there are cores,
    where one per input split or shuffle partition would be very many very small ones. Files go when
    the driver ends, or earlier through ``discard``.
    """
    spark = df.sparkSession
    if narrow:
        df = df.repartition(max(1, spark.sparkContext.defaultParallelism))
    path = f"{shared_dir(spark)}/vx-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._vx_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a ``materialise``d frame that nothing reads any more."""
    path = getattr(df, "_vx_path", None)
    if path:
        spark = df.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def join_checked(big: DataFrame, small: DataFrame, on, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``small`` (materialised, so counting is cheap) up to ``limit`` rows, else leave the join to Spark."""
    return big.join(F.broadcast(small) if small.limit(limit + 1).count() <= limit else small, on, how)


def bounded_batches(df: DataFrame) -> None:
    """Before texts go to Python: at most ``BATCH_ROWS`` of them at once, unless the session asks for fewer."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
