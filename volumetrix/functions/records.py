"""Records as DataFrames: decoding, encoding, table functions and relational forms."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import ROOT
from . import decode, encode

DECODED = "volume string, mft_index bigint, parent bigint, name string, size bigint, is_directory boolean, torn boolean"


def decode_records(records: DataFrame, sector: int = 512) -> DataFrame:
    """``records``: volume, mft_index, record (binary). Rows that hold no file are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for volume, index, data in zip(*[c.to_pylist() for c in batch.columns]):
                info = decode.file_info(data, sector) if data else None
                if info:
                    rows.append((volume, index, *info))
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["volume", "mft_index", "parent", "name", "size", "is_directory", "torn"])

    return records.select("volume", "mft_index", "record").mapInArrow(run, DECODED)


def encode_records(files: DataFrame, record_size: int = 1024) -> DataFrame:
    """The inverse: volume, mft_index, record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [encode.file_record(n, p, s, d, record_size) for n, p, s, d in zip(*[batch.column(k).to_pylist() for k in range(2, 6)])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], names=["volume", "mft_index", "record"])

    return files.select("volume", "mft_index", "name", "parent", "size", "is_directory").mapInArrow(run, "volume string, mft_index bigint, record binary")


def encode_attributes(files: DataFrame, record_size: int = 1024) -> DataFrame:
    """Records with any names and data: volume, mft_index, record of rows with volume, mft_index, is_directory, names, resident, allocated.

    ``names``: array of (name, parent, size, namespace, flags) in order. ``resident``: bytes of a data attribute inside
    the record; ``allocated``: size of one outside it; null for none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for directory, names, inside, outside in zip(*[batch.column(k).to_pylist() for k in range(2, 6)]):
                parts = [encode.name_attribute(n["name"], n["parent"], n["size"], n["namespace"], n["flags"]) for n in names]
                parts += [encode.resident(decode.ATTR_DATA, bytes(inside))] if inside is not None else []
                parts += [encode.data_attribute(encode.run_list([(9, 3), (None, 2), (4, 300)]), outside, outside)] if outside is not None else []
                data.append(encode.record(parts, 1 | 2 * directory, record_size))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], names=["volume", "mft_index", "record"])

    return files.select("volume", "mft_index", "is_directory", "names", "resident", "allocated").mapInArrow(run, "volume string, mft_index bigint, record binary")


@F.udtf(returnType="position int, kind bigint, start int, length bigint, non_resident boolean")
class MftAttributes:
    """Attributes of a record, in order."""

    def eval(self, record: bytes):
        for k, a in enumerate(decode.attributes(decode.fixup(bytes(record))[0]) if record else ()):
            yield k, a.kind, a.start, a.length, a.non_resident


@F.udtf(returnType="position int, clusters bigint, delta bigint")
class DataRuns:
    """Runs of an encoded run list; delta is null for a sparse run."""

    def eval(self, data: bytes):
        for k, (count, delta) in enumerate(decode.runs(bytes(data)) if data else ()):
            yield k, count, delta


def register_table_functions(spark) -> None:
    spark.udtf.register("mft_attributes", MftAttributes)
    spark.udtf.register("data_runs", DataRuns)


def choose_name(names: DataFrame, keys: list[str], position: str = "position", namespace: str = "namespace", value: str = "name") -> DataFrame:
    """Per key the first Win32 name, else the last name. One aggregation with map-side combine."""
    win32 = F.when(F.col(namespace).isin(*decode.WIN32_NAMESPACES), F.col(position))
    return names.groupBy(*keys).agg(F.coalesce(F.min_by(value, win32), F.max_by(value, position)).alias(value))


def absolute_runs(runs: DataFrame, keys: list[str], order: str, clusters: str = "clusters", delta: str = "delta") -> DataFrame:
    """Adds ``start``: the running sum of deltas per key; sparse runs (null delta) have none."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("start", F.when(F.col(delta).isNotNull(), F.sum(delta).over(w)))


def data_size(present: Column, non_resident: Column, allocated: Column, length: Column) -> Column:
    return F.when(~F.coalesce(present, F.lit(False)), F.lit(0).cast("long")).when(non_resident, allocated).otherwise(length)


def chunks(buffers: DataFrame, record_size: int) -> DataFrame:
    """volume, mft_index, record of buffers (volume, first_index, data), each a whole number of records."""
    n = (F.length("data") / record_size).cast("int")
    return (
        buffers.withColumn("k", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))))
        .select("volume", (F.col("first_index") + F.col("k")).alias("mft_index"), F.substring("data", F.col("k") * record_size + 1, F.lit(record_size)).alias("record"))
    )


def root_row(volume: str = "C") -> tuple:
    return volume, ROOT, ROOT, ".", 0, True


