"""``spark.read.format("mft")``: files of a volume image, decoded in parallel.

Options: path (several images: comma-separated), volume (letters in the same order, default C),
bytesPerCluster, bytesPerRecord, bytesPerSector, mftStartLcn, groups. The driver reads record 0 only,
to learn where the table lies; ranges are dealt to tasks in whole clusters and records. Paths may be
URIs of any file system that Arrow opens (file, s3, gs, abfs, hdfs); ``images.read_image`` reads others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import decode
from ..operators.runs import split_runs
from .files import opened
from .images import table_ranges

SCHEMA = "volume string, mft_index bigint, parent bigint, name string, size bigint, is_directory boolean, torn boolean"
BATCH = 4096


@dataclass
class Ranges(InputPartition):
    volume: str
    path: str
    first: int
    ranges: list


class MftReader(DataSourceReader):
    def __init__(self, options: dict):
        get = lambda k, d: int(options.get(k, d))
        self.cluster, self.record, self.sector = get("bytespercluster", 4096), get("bytesperrecord", 1024), get("bytespersector", 512)
        self.start, self.groups = get("mftstartlcn", 4), get("groups", 8)
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.volumes = options.get("volume", ",".join("CDEFGHIJKLMNOPQRSTUVWXYZ")).split(",")
        if not self.paths or len(self.paths) > len(self.volumes):
            raise ValueError("option path names the images, option volume a letter for each")

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        unit = math.lcm(self.cluster, self.record)
        for volume, path in zip(self.volumes, self.paths):
            with opened(path) as image:
                image.seek(self.start * self.cluster)
                runs = table_ranges(image.read(self.record), self.cluster, self.sector, path)
            total = sum(b - a for a, b in runs)
            # a last part that is no whole unit goes with the last group
            whole, at = [], 0
            for a, b in runs:
                take = max(0, min(b - a, total // unit * unit - at))
                whole += [(a, a + take)] if take else []
                at += b - a
            groups = split_runs(whole, max(1, min(self.groups, total // unit)), unit)
            first = 0
            for ranges in groups:
                if ranges:
                    out.append(Ranges(volume, path, first // self.record, ranges))
                first += sum(b - a for a, b in ranges)
        return out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        index, rows, rest = partition.first, [], b""
        with opened(partition.path) as image:
            for a, b in partition.ranges:
                while a < b:
                    image.seek(a)
                    data = rest + image.read(min(b - a, BATCH * self.record))
                    if len(data) == len(rest):
                        raise ValueError(f"{partition.path}: ends inside the table")
                    a += len(data) - len(rest)
                    whole = len(data) // self.record * self.record
                    for k in range(0, whole, self.record):
                        info = decode.file_info(data[k : k + self.record], self.sector)
                        if info:
                            rows.append((partition.volume, index, *info))
                        index += 1
                    rest = data[whole:]
                    if rows:
                        yield self.batch(rows)
                        rows = []

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.bool_())
        names = ["volume", "mft_index", "parent", "name", "size", "is_directory", "torn"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


class MftSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mft"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return MftReader({k.lower(): v for k, v in self.options.items()})
