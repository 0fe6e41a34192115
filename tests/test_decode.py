"""Golden bytes, round trips, images and the batch source."""

from __future__ import annotations

import struct

import pytest

from volumetrix.api import Index, build_index, register_sources
from volumetrix.functions import decode, encode, records
from volumetrix.operators.runs import split_runs

#: A used file record written by hand from the layout: one resident name attribute, no data.
GOLDEN = bytes.fromhex(
    "46494c45 3000 0300 0000000000000000 0100 0100 3800 0100 b8000000 00040000 0000000000000000 0000"
    "000000000000 aa55 1122 3344 0000"
    "30000000 60000000 00 00 1800 0000 0000 48000000 1800 00 00"
    "0a00000000000900 0000000000000000 0000000000000000 0000000000000000 0000000000000000 0000000000000000"
    "2a00000000000000 00000000 00000000 03 01 6100 6200 6300"
    .replace(" ", "")
)


def golden() -> bytes:
    body = GOLDEN.ljust(56 + 96, b"\0") + struct.pack("<II", 0xFFFFFFFF, 0)
    out = bytearray(body.ljust(1024, b"\0"))
    out[510:512] = out[1022:1024] = b"\xaa\x55"
    return bytes(out)


def test_golden_record():
    info = decode.file_info(golden())
    assert info == (10, "abc", 42, False, False)
    fixed, torn = decode.fixup(golden())
    assert fixed[510:512] == b"\x11\x22" and fixed[1022:1024] == b"\x33\x44" and not torn
    broken = bytearray(golden())
    broken[510] ^= 1
    assert decode.file_info(bytes(broken)).torn


@pytest.mark.parametrize("namespaces, chosen", [((0, 2, 1, 1), 2), ((0, 2), 1), ((3,), 0), ((2, 1), 1), ((0,), 0)])
def test_name_choice(namespaces, chosen):
    record = encode.record([encode.name_attribute(f"n{k}", 5, k, ns) for k, ns in enumerate(namespaces)])
    assert decode.file_info(record)[1:3] == (f"n{chosen}", chosen)


def test_records_without_a_file():
    good = encode.file_record("x", 5, 0, False)
    assert decode.file_info(b"BAAD" + good[4:]) is None
    assert decode.file_info(encode.record([encode.name_attribute("x", 5)], flags=2)) is None
    assert decode.file_info(encode.record([])) is None
    assert decode.file_info(encode.record([encode.name_attribute("x", 5, flags=0x400)])) is None
    assert decode.file_info(good[:30]) is None and decode.file_info(b"") is None
    assert decode.file_info(encode.record([encode.name_attribute("x", 5), struct.pack("<II", 0x80, 0) + b"\0" * 16])).name == "x"
    assert decode.file_info(encode.record([encode.name_attribute("a\ud800b", 5)])).name == "a�b"
    assert decode.file_info(encode.record([encode.name_attribute("x", 5)], flags=3)).is_directory
    assert decode.file_info(encode.record([encode.name_attribute("x", (9 << 48) | 77)])).parent == 77


def test_sizes():
    name = encode.name_attribute("x", 5, 100)
    assert decode.file_info(encode.record([name])).size == 100
    assert decode.file_info(encode.record([name, encode.resident(0x80, b"d" * 150)])).size == 150
    assert decode.file_info(encode.record([name, encode.data_attribute(b"\0", 8192, 5000)])).size == 8192
    assert decode.file_info(encode.record([encode.name_attribute("x", 5, 9999), encode.data_attribute(b"\0", 8192, 5000)])).size == 9999


def test_data_runs():
    ranges = lambda data, real=1: decode.data_ranges(encode.record([encode.data_attribute(bytes.fromhex(data), 1, real)]), 4096)
    assert ranges("2118345600") == [(90390528, 90488832)]
    assert ranges("211834561108F000") == [(90390528, 90488832), (90324992, 90357760)]
    assert ranges("2118345600", real=0) == []
    assert ranges("0105 2118345600") == [(90390528, 90488832)]  # a sparse run has no place
    assert decode.data_ranges(encode.record([encode.resident(0x80, b"x")]), 4096) is None
    assert decode.runs(encode.run_list([(10, 3), (None, 2), (4, 300)])) == [(3, 10), (2, None), (300, -6)]


def test_split_runs():
    assert split_runs([(0, 24576), (81920, 98304)], 3, 4096) == [[(0, 12288)], [(12288, 24576)], [(81920, 98304)]]
    assert split_runs([(0, 4096)], 3, 4096) == [[], [], [(0, 4096)]]


def make_image(path, n=300):
    rows = [(5, ".", 0, True)] * 6 + [(5, f"d{k}", 0, True) for k in range(6, 20)] + [(6 + k % 14, f"f{k}.txt", k, False) for k in range(20, n)]
    data = [b"\0" * 1024 if k % 37 == 36 else encode.file_record(name, parent, size, directory) for k, (parent, name, size, directory) in enumerate(rows)]
    # record 0 is the table's own
    path.write_bytes(encode.image(data[1:], [(4, 30), (60, 25), (40, 20)]))
    return {k: r for k, r in enumerate(rows) if k and k % 37 != 36}


@pytest.mark.parametrize("groups", [1, 4, 50])
def test_image_source(spark, tmp_path, groups):
    want = make_image(tmp_path / "c.img")
    register_sources(spark)
    df = spark.read.format("mft").options(path=str(tmp_path / "c.img"), groups=groups).load()
    got = {r.mft_index: (r.parent, r.name, r.size, r.is_directory) for r in df.collect()}
    assert got.pop(0)[1] == "$MFT"
    assert got == want and df.where("torn").count() == 0


def test_image_of_small_clusters(spark, tmp_path):
    data = [encode.file_record(f"f{k}", 5, k, False) for k in range(1, 12)]
    (tmp_path / "s.img").write_bytes(encode.image(data, [(4, 10), (30, 14)], cluster=512))
    register_sources(spark)
    rows = spark.read.format("mft").options(path=str(tmp_path / "s.img"), bytesPerCluster=512, groups=5).load().collect()
    assert sorted((r.mft_index, r.name) for r in rows if r.mft_index) == [(k, f"f{k}") for k in range(1, 12)]


def test_index_over_an_image(spark, tmp_path):
    make_image(tmp_path / "c.img")
    index = build_index(spark, str(tmp_path / "c.img"), volume="d")
    assert isinstance(index, Index) and index.count() == index.files.count()
    assert [(r.mft_index, r.path, r.size) for r in index.search("d13/f21.").collect()] == [(21, "D:\\d13\\f21.txt", 21)]
    assert index.find_by_name("f25.txt").first().mft_index == 25
    assert [r.mft_index for r in index.page("txt", 3, 2).collect()] == sorted(r.mft_index for r in index.matching("txt").collect())[3:5]
    index.close()


def test_table_functions(spark):
    records.register_table_functions(spark)
    rec = encode.record([encode.name_attribute("x", 5), encode.resident(0x80, b"abc")])
    spark.createDataFrame([(bytearray(rec), bytearray(encode.run_list([(10, 3), (4, 2)])))], "r binary, d binary").createOrReplaceTempView("rec")
    assert [r.kind for r in spark.sql("select a.kind from rec, lateral mft_attributes(r) a order by a.position").collect()] == [0x30, 0x80]
    assert [(r.clusters, r.delta) for r in spark.sql("select a.* from rec, lateral data_runs(d) a order by a.position").collect()] == [(3, 10), (2, -6)]


def test_chunks(spark):
    data = b"".join(encode.file_record(f"f{k}", 5, k, False) for k in range(4))
    buffers = spark.createDataFrame([("C", 8, bytearray(data)), ("C", 0, bytearray(b""))], "volume string, first_index long, data binary")
    rows = records.decode_records(records.chunks(buffers, 1024)).collect()
    assert sorted((r.mft_index, r.name) for r in rows) == [(8 + k, f"f{k}") for k in range(4)]
