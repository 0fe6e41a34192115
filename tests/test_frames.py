"""Raw journal buffers against bytes written out by hand, and there and back."""

from __future__ import annotations

import struct

import pytest

from volumetrix.functions import frames
from volumetrix.functions.bits import record_number
from volumetrix.schema import REASON_FILE_CREATE, REASON_FILE_DELETE, REASON_RENAME_NEW_NAME

ROWS = [(100, REASON_FILE_CREATE, 0x0001_0000_0000_002A, 5, 0x20, "a.txt"), (180, 0x4, 43, 5, 0x20, "ignored"), (260, REASON_FILE_DELETE | 0x8000_0000, -1, 42, 0x10, "é\U0001f600"), (340, REASON_RENAME_NEW_NAME, 44, 5, 0, "")]


def test_bytes_by_hand():
    name = b"a\0b\0"
    frame = struct.pack("<IHH", 80, 3, 0) + (42).to_bytes(16, "little") + (5).to_bytes(16, "little") + struct.pack("<qqIIIIHH", 7, 0, 0x100, 0, 0, 0x10, 4, 76) + name
    assert len(frame) == 80
    assert list(frames.frames(struct.pack("<q", 99) + frame)) == [(7, 0x100, 42, 5, 0x10, "ab")]
    assert list(frames.frames(struct.pack("<q", 99))) == [] and list(frames.frames(b"")) == []


def test_there_and_back():
    data = frames.encode_frames(ROWS, 420)
    assert list(frames.frames(data)) == [r for r in ROWS if r[1] & 0x3300]
    assert list(frames.frames(data, 0xFFFF_FFFF)) == ROWS
    lone = frames.encode_frames([(1, 0x100, 2, 5, 0, "x\ud800y")], 2)
    assert [r[-1] for r in frames.frames(lone)] == ["x�y"]


@pytest.mark.parametrize("spoil", [lambda d: d[:8] + b"\0\0\0\0" + d[12:], lambda d: d[:-10], lambda d: d[:40], lambda d: d[:12] + b"\2\0" + d[14:]])
def test_broken_frames_are_errors(spoil):
    with pytest.raises(ValueError, match="journal frame"):
        list(frames.frames(spoil(frames.encode_frames(ROWS[:1], 420))))


def test_next_usn_never_goes_back():
    at = lambda usn, current: frames.next_usn(frames.encode_frames([], usn), current)
    assert (at(420, 100), at(100, 100), at(99, 100), at(0, 0), frames.next_usn(b"", 0)) == (420, 100, None, None, None)


def test_buffers_as_rows(spark):
    data = [("C", frames.encode_frames(ROWS, 420)), ("D", frames.encode_frames(ROWS[:1], 180)), ("D", None), ("E", b"")]
    df = frames.decode_journal(spark.createDataFrame(data, "volume string, data binary").repartition(3))
    found = df.withColumn("record", record_number(df.file_ref)).collect()
    assert sorted((r.volume, r.usn, r.record, r["name"]) for r in found) == [("C", 100, 42, "a.txt"), ("C", 260, 2**48 - 1, "é\U0001f600"), ("C", 340, 44, ""), ("D", 100, 42, "a.txt")]


def test_cursor_guard_of_buffers(spark):
    """Buffers without a next USN, or with one before the USN they were read from, have no rows."""
    data = [frames.encode_frames(ROWS, n) for n in (0, 50, 100, 400)]
    df = spark.createDataFrame([("C", bytearray(d), 100) for d in data] + [("C", bytearray(data[1]), None), ("C", None, 1)], "volume string, data binary, asked long")
    assert frames.decode_journal(df).count() == 3 * 3 and frames.decode_journal(df.drop("asked")).count() == 5 * 3
    at = spark.createDataFrame([(0, 100), (50, 100), (100, 100), (400, 100)], "n long, a long")
    assert [r[0] for r in at.select(frames.cursor_after(at.n, at.a)).collect()] == [100, 100, 100, 400]


def test_buffers_as_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.bin").write_bytes(frames.encode_frames(ROWS, 1000 + k))
    assert frames.decode_journal(frames.read_buffers(spark, str(tmp_path), "D")).groupBy("volume").count().collect() == [("D", 9)]
