"""Raw journal buffers: frames of version 3 to journal rows, and back.

A buffer starts with the next USN to ask for; then frame follows frame, each with its own length. A
frame that is shorter than its header, reaches past the buffer or has another version is an error:
what follows it cannot be trusted.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import JOURNAL, REASON_MASK

#: Fixed layout of the public Win32 SDK: length, major and minor version, two 16-byte ids, usn, time,
#: reason, source, security id, attributes, length and offset of the name; the name follows.
FRAME = struct.Struct("<IHH16s16sqqIIIIHH")
VERSION = 3
NEXT_USN = 8


def frames(buffer: bytes, mask: int = REASON_MASK) -> Iterator[tuple]:
    """usn, reason, file_ref, parent_ref, file_attributes, name of the frames whose reason meets ``mask``."""
    at = NEXT_USN
    while at < len(buffer):
        if at + FRAME.size > len(buffer):
            raise ValueError(f"journal frame at {at} is cut off")
        length, major, _, file_id, parent_id, usn, _, reason, _, _, attributes, name_length, name_offset = FRAME.unpack_from(buffer, at)
        if major != VERSION:
            raise ValueError(f"journal frame at {at} has version {major}")
        if length < FRAME.size or at + length > len(buffer) or name_offset + name_length > length:
            raise ValueError(f"journal frame at {at} has length {length}")
        if reason & mask:
            # of an id the first 8 bytes count, read as a signed long; masking to the record number is left to SQL
            file_ref, parent_ref = (struct.unpack_from("<q", x)[0] for x in (file_id, parent_id))
            name = buffer[at + name_offset : at + name_offset + name_length].decode("utf-16-le", "replace")
            yield usn, reason, file_ref, parent_ref, attributes, name
        at += length


def next_usn(buffer: bytes, current: int) -> int | None:
    """Where to go on after a buffer; None if it has no next USN or would go backwards, so that it is ignored."""
    if len(buffer) < NEXT_USN:
        return None
    found = struct.unpack_from("<q", buffer)[0]
    return found if found != 0 and found >= current else None


def encode_frames(rows: Iterable[tuple], following: int, version: int = VERSION) -> bytes:
    """The inverse of ``frames``; frames are padded to 8 bytes."""
    out = bytearray(struct.pack("<q", following))
    for usn, reason, file_ref, parent_ref, attributes, name in rows:
        text = name.encode("utf-16-le", "surrogatepass")
        length = -(-(FRAME.size + len(text)) // 8) * 8
        ids = (struct.pack("<qq", x, 0) for x in (file_ref, parent_ref))
        out += FRAME.pack(length, version, 0, *ids, usn, 0, reason, 0, 0, attributes, len(text), FRAME.size) + text
        out += bytes(length - FRAME.size - len(text))
    return bytes(out)


def cursor_after(following: Column, asked: Column) -> Column:
    """``next_usn`` for columns: where to go on, which is where one was if the buffer has no next USN or goes backwards."""
    return F.when((following != 0) & (following >= asked), following).otherwise(asked)


def read_buffers(spark: SparkSession, path: str, volume: str = "C") -> DataFrame:
    """Raw buffers kept as files, one read each, by Spark's own reader: volume, data."""
    return spark.read.format("binaryFile").load(path).select(F.lit(volume).alias("volume"), F.col("content").alias("data"))


def decode_journal(buffers: DataFrame, mask: int = REASON_MASK) -> DataFrame:
    """Journal rows of raw buffers (volume, data); map-only. Null and empty buffers have none.

    With a column ``asked`` (the USN a buffer was read from), buffers that the cursor guard refuses have none either.
    """
    guarded = "asked" in buffers.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        names = ["volume", "usn", "reason", "file_ref", "parent_ref", "file_attributes", "name"]
        for batch in batches:
            asked = batch.column(2).to_pylist() if guarded else [None] * batch.num_rows
            for volume, data, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), asked):
                rows = [(volume, *r) for r in frames(data, mask)] if data and (at is None or next_usn(data, at) is not None) else []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return buffers.select("volume", "data", *(["asked"] if guarded else [])).mapInArrow(run, JOURNAL)


def encode_journal(rows: DataFrame, following: int) -> DataFrame:
    """Raw buffers (volume, data) of journal rows, one per volume and Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            volumes: dict[str, list] = {}
            for volume, *row in zip(*[c.to_pylist() for c in batch.columns]):
                volumes.setdefault(volume, []).append(row)
            data = [encode_frames(found, following) for found in volumes.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(volumes), pa.string()), pa.array(data, pa.binary())], names=["volume", "data"])

    return rows.select("volume", "usn", "reason", "file_ref", "parent_ref", "file_attributes", "name").mapInArrow(run, "volume string, data binary")
