"""Master-file-table records: bytes to plain Python values, with every length checked.

Anything short, broken or looping yields nothing for that record instead of an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

from ..schema import ID_MASK

MAGIC = b"FILE"
ATTR_FILE_NAME, ATTR_DATA, ATTR_END = 0x30, 0x80, 0xFFFFFFFF
REPARSE_POINT = 0x0400
#: Namespaces whose names are Win32 names.
WIN32_NAMESPACES = (1, 3)
HEADER, ATTR_HEADER = 42, 16


class Header(NamedTuple):
    usa_offset: int
    usa_count: int
    first_attribute: int
    flags: int
    bytes_used: int

    @property
    def used(self) -> bool:
        return bool(self.flags & 1)

    @property
    def is_directory(self) -> bool:
        return bool(self.flags & 2)


class Attribute(NamedTuple):
    kind: int
    start: int
    length: int
    non_resident: bool


class FileInfo(NamedTuple):
    parent: int
    name: str
    size: int
    is_directory: bool
    torn: bool


_HEADER, _PAIR, _NAME = struct.Struct("<4xHH12xHHI"), struct.Struct("<II"), struct.Struct("<Q40xQI4xBB")


def header(record: bytes) -> Header | None:
    if len(record) < HEADER or record[:4] != MAGIC:
        return None
    return Header._make(_HEADER.unpack_from(record))


def fixup(record: bytes, sector: int = 512, head: Header | None = None) -> tuple[bytes, bool]:
    """The record with its sectors' last words restored, and whether a sector was torn."""
    head = head or header(record)
    if head is None or head.usa_offset + 2 * head.usa_count > len(record):
        return record, False
    words = struct.unpack_from(f"<{head.usa_count}H", record, head.usa_offset)
    out, torn, stamp = bytearray(record), False, record[head.usa_offset : head.usa_offset + 2]
    for k in range(1, len(words)):
        at = k * sector - 2
        if at + 2 > len(out):
            break
        torn |= out[at : at + 2] != stamp
        out[at : at + 2] = words[k].to_bytes(2, "little")
    return bytes(out), torn


def attributes(record: bytes, head: Header | None = None) -> Iterator[Attribute]:
    head = head or header(record)
    if head is None:
        return
    at, end = head.first_attribute, min(head.bytes_used, len(record))
    while at + ATTR_HEADER <= end:
        kind, length = _PAIR.unpack_from(record, at)
        if kind == ATTR_END or length < ATTR_HEADER or at + length > len(record):
            return
        yield Attribute(kind, at, length, record[at + 8] != 0)
        at += length


def resident_value(record: bytes, a: Attribute) -> bytes | None:
    if a.non_resident or a.length < 24:
        return None
    size, offset = struct.unpack_from("<IH", record, a.start + 16)
    value = record[a.start + offset : a.start + offset + size]
    return value if len(value) == size else None


def name_of(record: bytes, a: Attribute) -> tuple[int, int, str, int] | None:
    """Size, parent, name and namespace of a name attribute; None for a reparse point or one that is cut off."""
    value = resident_value(record, a)
    if value is None or len(value) < 0x42:
        return None
    parent, size, flags, units, namespace = _NAME.unpack_from(value)
    if flags & REPARSE_POINT or len(value) < 0x42 + 2 * units:
        return None
    return size, parent & ID_MASK, value[0x42 : 0x42 + 2 * units].decode("utf-16-le", "replace"), namespace


def size_of(record: bytes, a: Attribute) -> int:
    """Of a data attribute: allocated bytes if it lies outside the record, else its length."""
    if a.non_resident:
        return struct.unpack_from("<Q", record, a.start + 40)[0] if a.length >= 64 else 0
    return struct.unpack_from("<I", record, a.start + 16)[0] if a.length >= 24 else 0


def name_and_size(record: bytes, head: Header | None = None) -> tuple[tuple[int, int, str, int] | None, int]:
    """The first Win32 name, else the last name, and the size of the first data attribute (0 without one), in one walk."""
    chosen, size = None, None
    for a in attributes(record, head):
        if a.kind == ATTR_FILE_NAME and (chosen is None or chosen[3] not in WIN32_NAMESPACES):
            chosen = name_of(record, a) or chosen
        elif a.kind == ATTR_DATA and size is None:
            size = size_of(record, a)
    return chosen, size or 0


def file_name(record: bytes) -> tuple[int, int, str] | None:
    """Size, parent and name of the chosen name."""
    chosen, _ = name_and_size(record)
    return chosen and chosen[:3]


def data_size(record: bytes) -> int:
    return name_and_size(record)[1]


def file_info(record: bytes, sector: int = 512) -> FileInfo | None:
    """What the index keeps of a record; None for one that is invalid, unused or nameless."""
    head = header(record)
    if head is None or not head.used:
        return None
    record, torn = fixup(record, sector, head)
    name, data = name_and_size(record, head)
    if name is None:
        return None
    size = max(data, name[0])
    if size >= 1 << 63:  # no file's: the record is corrupt, and one such record must not end a load
        return None
    return FileInfo(name[1], name[2], size, head.is_directory, torn)


def runs(data: bytes) -> list[tuple[int, int]]:
    """Cluster count and signed delta of each run; a run without offset bytes is sparse (delta None)."""
    out, at = [], 0
    while at < len(data) and data[at]:
        n_count, n_delta = data[at] & 15, data[at] >> 4
        if at + 1 + n_count + n_delta > len(data):
            break
        count = int.from_bytes(data[at + 1 : at + 1 + n_count], "little")
        delta = int.from_bytes(data[at + 1 + n_count : at + 1 + n_count + n_delta], "little", signed=True) if n_delta else None
        out.append((count, delta))
        at += 1 + n_count + n_delta
    return out


def data_ranges(record: bytes, bytes_per_cluster: int) -> list[tuple[int, int]] | None:
    """Byte ranges of the first data attribute; None if it lies inside the record, sparse runs left out."""
    for a in attributes(record):
        if a.kind != ATTR_DATA:
            continue
        if not a.non_resident or a.length < 64:
            return None
        offset, = struct.unpack_from("<H", record, a.start + 32)
        real, = struct.unpack_from("<Q", record, a.start + 48)
        if real == 0:
            return []
        out, cluster = [], 0
        for count, delta in runs(record[a.start + offset : a.start + a.length]):
            if delta is not None:
                cluster += delta
                out.append((cluster * bytes_per_cluster, (cluster + count) * bytes_per_cluster))
        return out
    return None
