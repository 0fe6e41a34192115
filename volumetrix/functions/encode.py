"""Builds records and volume images, for round trips and fixtures."""

from __future__ import annotations

import struct

from . import decode

SECTOR = 512


def resident(kind: int, value: bytes, ident: int = 0) -> bytes:
    length = -(-(24 + len(value)) // 8) * 8
    return (struct.pack("<IIBBHHHIHBB", kind, length, 0, 0, 24, 0, ident, len(value), 24, 0, 0) + value).ljust(length, b"\0")


def name_attribute(name: str, parent: int, size: int = 0, namespace: int = 3, flags: int = 0) -> bytes:
    text = name.encode("utf-16-le", "surrogatepass")
    value = struct.pack("<Q", parent).ljust(0x30, b"\0") + struct.pack("<QII", size, flags, 0)[:16]
    value = value[:0x40].ljust(0x40, b"\0") + bytes([len(text) // 2, namespace]) + text
    return resident(decode.ATTR_FILE_NAME, value)


def data_attribute(run_bytes: bytes, allocated: int, real: int) -> bytes:
    length = -(-(64 + len(run_bytes)) // 8) * 8
    head = struct.pack("<IIBBHHH", decode.ATTR_DATA, length, 1, 0, 64, 0, 0)
    return (head + struct.pack("<QQHHIQQQ", 0, 0, 64, 0, 0, allocated, real, real) + run_bytes).ljust(length, b"\0")


def signed_bytes(x: int) -> bytes:
    n = 1
    while not -(1 << (8 * n - 1)) <= x < 1 << (8 * n - 1):
        n += 1
    return x.to_bytes(n, "little", signed=True)


def run_list(ranges: list[tuple[int, int]]) -> bytes:
    """Runs of (first cluster, clusters), absolute; a first cluster of None is sparse."""
    out, last = b"", 0
    for first, count in ranges:
        size = count.to_bytes(-(-count.bit_length() // 8) or 1, "little")
        delta = b"" if first is None else signed_bytes(first - last)
        last = last if first is None else first
        out += bytes([len(delta) << 4 | len(size)]) + size + delta
    return out + b"\0"


def record(attributes: list[bytes], flags: int = 1, size: int = 1024, stamp: int = 7) -> bytes:
    """A record with its update sequence applied, as it lies on disk."""
    words = size // SECTOR + 1
    first = -(-(48 + 2 * words) // 8) * 8
    body = b"".join(attributes) + struct.pack("<II", decode.ATTR_END, 0)
    used = first + len(body)
    if used > size:
        raise ValueError("attributes do not fit the record")
    head = decode.MAGIC + struct.pack("<HHQHHHHIIQH", 48, words, 0, 1, 1, first, flags, used, size, 0, 0)
    out = bytearray(head.ljust(48, b"\0").ljust(first, b"\0") + body).ljust(size, b"\0")
    struct.pack_into("<H", out, 48, stamp)
    for k in range(1, words):
        out[48 + 2 * k : 50 + 2 * k] = out[k * SECTOR - 2 : k * SECTOR]
        struct.pack_into("<H", out, k * SECTOR - 2, stamp)
    return bytes(out)


def file_record(name: str, parent: int, size: int, is_directory: bool, record_size: int = 1024) -> bytes:
    return record([name_attribute(name, parent, size)], 1 | 2 * is_directory, record_size)


def image(records: list[bytes], fragments: list[tuple[int, int]], cluster: int = 4096, record_size: int = 1024) -> bytes:
    """A volume image whose table lies in ``fragments`` (first cluster, clusters); record 0 is made here."""
    total = sum(n for _, n in fragments) * cluster
    table = record([name_attribute("$MFT", 5, total), data_attribute(run_list(fragments), total, total)], 1, record_size) + b"".join(records)
    if len(table) > total:
        raise ValueError("records do not fit the fragments")
    table, out, at = table.ljust(total, b"\0"), bytearray(max(f + n for f, n in fragments) * cluster), 0
    for first, n in fragments:
        out[first * cluster : (first + n) * cluster] = table[at : at + n * cluster]
        at += n * cluster
    return bytes(out)
