"""Volume images through Spark's and Hadoop's own readers, for stores that only these reach; and an image writer.

``format("mft")`` seeks to the table's ranges and reads nothing else, on any file system that Arrow
knows. ``read_image`` needs no file system in Python: fixed-length records of a cluster are read by
Hadoop's input format in parallel, and those in the table's ranges are kept. It reads the whole image.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions import decode, encode, records

FORMAT = "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat"
KEY, VALUE = "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable"


def table_ranges(record: bytes, cluster: int, sector: int, path: str) -> list[tuple[int, int]]:
    """Byte ranges of the table, in its order, from its own first record."""
    found = decode.data_ranges(decode.fixup(record, sector)[0], cluster)
    if found is None:
        raise ValueError(f"{path}: record 0 has no data attribute")
    return found


def read_image(spark: SparkSession, path: str, volume: str = "C", cluster: int = 4096, record: int = 1024, sector: int = 512, start: int = 4) -> DataFrame:
    """volume, mft_index, record (binary) of every record of the table; decode with ``records.decode_records``."""
    runs, places, at = table_ranges(storage.read_bytes(spark, path, start * cluster, record), cluster, sector, path), [], 0
    for a, b in runs:
        places.append((a, b, at))
        at += b - a
    places.sort()
    starts = [a for a, _, _ in places]

    def pick(rows: Iterator[tuple]) -> Iterator[tuple]:
        for where, data in rows:
            k = bisect_right(starts, where) - 1
            if k >= 0 and where < places[k][1]:
                yield volume, places[k][2] + where - places[k][0], bytearray(data)

    raw = spark.sparkContext.newAPIHadoopFile(path, FORMAT, KEY, VALUE, conf={"fixedlengthinputformat.record.length": str(cluster)})
    parts = spark.createDataFrame(raw.mapPartitions(pick), "volume string, at long, data binary")
    if cluster < record:  # records lie over several clusters, which need not meet in one task
        part = F.struct("at", "data").alias("part")
        parts = parts.groupBy("volume", F.floor(F.col("at") / record).alias("k")).agg(F.array_sort(F.collect_list(part)).alias("parts"))
        whole = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["data"]))
        parts = parts.select("volume", (F.col("k") * record).alias("at"), whole.alias("data"))
    return records.chunks(parts.select("volume", F.floor(F.col("at") / record).cast("long").alias("first_index"), "data"), record)


def write_image(files: DataFrame, path: str, slots: int, cluster: int = 4096, record: int = 1024, fragments: int = 2) -> None:
    """Writes records (mft_index, record; 0 is made here) as an image whose table lies in a few fragments.

    Records stream through the driver in order, a partition at a time; for fixtures and round trips.
    """
    spark = files.sparkSession
    total = -(-slots * record // cluster)
    sizes = [total // fragments + (k < total % fragments) for k in range(fragments)]
    runs, at = [], 4
    for n in sizes:
        runs.append((at, n))
        at += n + 3
    fs, target = storage.hadoop(spark, path)
    out = fs.create(target)
    try:
        out.write(bytearray(4 * cluster))
        room, gaps = [n * cluster for _, n in runs], 0
        head = encode.record([encode.name_attribute("$MFT", 5, total * cluster), encode.data_attribute(encode.run_list(runs), total * cluster, total * cluster)], 1, record)
        pending, following = bytearray(head), 1
        for row in files.where("mft_index > 0").orderBy("mft_index").select("mft_index", "record").toLocalIterator():
            pending += bytes((row.mft_index - following) * record) + row.record
            following = row.mft_index + 1
            while gaps < len(room) and len(pending) >= min(1 << 20, room[gaps]):
                take = min(len(pending), room[gaps])
                out.write(pending[:take])
                pending, room[gaps] = pending[take:], room[gaps] - take
                if not room[gaps]:
                    gaps += 1
                    out.write(bytearray(3 * cluster))
        pending += bytes(max(0, sum(room) - len(pending)))
        for k in range(gaps, len(room)):
            out.write(pending[: room[k]] + bytearray(3 * cluster))
            pending = pending[room[k] :]
    finally:
        out.close()
