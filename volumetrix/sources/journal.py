"""``format("fsjournal")``: a change journal kept as Parquet files, in batch and as a stream.

Options: path, startingUsn (latest, earliest or a number; stream default latest), maxPerBatch. The
stream's offset is the next USN to read. Only the four reasons the index follows are read, and in
batch the filters on usn (>, >=, <, <=) and volume = v are pushed into the Parquet scan. Paths may be
URIs of any file system that Arrow opens. ``read_journal`` reads the same files by Spark's own reader.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..schema import JOURNAL, REASON_MASK
from .files import located, parquet_files

COLUMNS = ["volume", "usn", "reason", "file_ref", "parent_ref", "file_attributes", "name"]


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """The journal in batch, from any store that Spark reads, with the filters Spark itself pushes down."""
    return spark.read.schema(JOURNAL).parquet(path).where(F.col("reason").bitwiseAND(F.lit(REASON_MASK)) != 0)


def usn_bounds(system: FileSystem, file: str) -> tuple[int, int] | None:
    """First and last USN of a file, from its footer where statistics are there."""
    with system.open_input_file(file) as opened:
        meta = pa.parquet.ParquetFile(opened).metadata
        at = meta.schema.to_arrow_schema().get_field_index("usn")
        stats = [meta.row_group(k).column(at).statistics for k in range(meta.num_row_groups)]
    if meta.num_rows == 0:
        return None
    if all(s is not None and s.has_min_max for s in stats):
        return min(s.min for s in stats), max(s.max for s in stats)
    found = pc.min_max(ds.dataset(file, filesystem=system).to_table(columns=["usn"])["usn"]).as_py()
    return found["min"], found["max"]


@dataclass
class Slice(InputPartition):
    path: str
    file: str
    start: int | None
    end: int | None
    volume: str | None = None


def scan(part: Slice) -> Iterator[pa.RecordBatch]:
    keep = pc.not_equal(pc.bit_wise_and(ds.field("reason"), REASON_MASK), 0)
    if part.start is not None:
        keep &= ds.field("usn") >= part.start
    if part.end is not None:
        keep &= ds.field("usn") < part.end
    if part.volume is not None:
        keep &= ds.field("volume") == part.volume
    yield from (b for b in ds.dataset(part.file, filesystem=located(part.path)[0]).to_batches(columns=COLUMNS, filter=keep) if b.num_rows)


class JournalReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.start, self.end, self.volume = path, None, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column == "usn" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                least = f.value + isinstance(f, GreaterThan)
                self.start = least if self.start is None else max(self.start, least)
            elif column == "usn" and isinstance(f, (LessThan, LessThanOrEqual)):
                below = f.value + isinstance(f, LessThanOrEqual)
                self.end = below if self.end is None else min(self.end, below)
            elif column == "volume" and isinstance(f, EqualTo) and self.volume in (None, f.value):
                self.volume = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [Slice(self.path, f, self.start, self.end, self.volume) for f in parquet_files(self.path)[1]]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return scan(partition)


class JournalStreamReader(DataSourceStreamReader):
    def __init__(self, path: str, starting: str, per_batch: int | None):
        self.path, self.starting, self.per_batch = path, starting, per_batch
        self.next = None

    def end(self) -> int:
        return max((b[1] + 1 for _, b in self.bounds()), default=0)

    def bounds(self) -> Iterator[tuple[str, tuple[int, int]]]:
        system, files = parquet_files(self.path)
        return ((f, b) for f in files if (b := usn_bounds(system, f)))

    def initialOffset(self) -> dict:
        usn = self.end() if self.starting == "latest" else 0 if self.starting == "earliest" else int(self.starting)
        return {"usn": usn}

    def latestOffset(self) -> dict:
        end = self.end()
        if self.per_batch is not None:
            at = self.initialOffset()["usn"] if self.next is None else self.next
            end = min(end, max(at, 0) + self.per_batch)
        self.next = end if self.next is None else max(self.next, end)  # never backwards
        return {"usn": self.next}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Slice(self.path, f, start["usn"], end["usn"]) for f, b in self.bounds() if b[0] < end["usn"] and b[1] >= start["usn"]]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return scan(partition)

    def commit(self, end: dict) -> None:
        return None


class JournalSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fsjournal"

    def schema(self) -> str:
        return JOURNAL

    def reader(self, schema) -> DataSourceReader:
        return JournalReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        per_batch = self.options.get("maxPerBatch")
        return JournalStreamReader(self.options["path"], self.options.get("startingUsn", "latest"), int(per_batch) if per_batch else None)
