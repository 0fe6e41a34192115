"""Exact dedup in two passes over a Bloom filter.

Pass one: every task sets two bits per text hash in a plane of its own, and in a second plane those
bits that it has set before; planes merge in a tree, a bit set on both sides moving to the second
plane. Pass two: a text is possibly repeated only if both its bits are in the merged second plane.
Those rows alone are shuffled, by SHA-256, to be settled exactly; all others pass straight through.

The filter has 16 bits a row. A plane has at most ``MAX_BITS`` (32 MB to merge and broadcast); more
rows are dealt by a hash into ranges that each have a plane of their own, one after the other, so the
filter grows with the data and what is broadcast at once does not.

Edge cases: a null text counts as empty. Ties: of rows with one doc_id and one text exactly one stays.
A null doc_id is the smallest. Other columns are carried by ``drop_exact_duplicates`` and never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

BITS_PER_ROW, MIN_BITS, MAX_BITS = 16, 1 << 11, 1 << 28


def filter_bits(rows: int, most: int = MAX_BITS) -> int:
    bits = MIN_BITS
    while bits < rows * BITS_PER_ROW and bits < most:
        bits *= 2
    return bits


def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each 64-bit hash."""
    h = hashes.astype(np.int64).view(np.uint64)
    return h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)


def add(planes: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> None:
    """Set bits ``at``, each an insertion of its own."""
    once, twice = planes
    at, n = np.unique(at, return_counts=True)
    byte, bit = (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    again = (n > 1) | ((once[byte] & bit) > 0)
    np.bitwise_or.at(twice, byte[again], bit[again])
    np.bitwise_or.at(once, byte, bit)


def merge(a: tuple[bytes, bytes], b: tuple[bytes, bytes]) -> tuple[bytes, bytes]:
    (a1, a2), (b1, b2) = ((np.frombuffer(zlib.decompress(p), np.uint8) for p in x) for x in (a, b))
    return pack((a1 | b1, a2 | b2 | (a1 & b1)))


def pack(planes: tuple[np.ndarray, np.ndarray]) -> tuple[bytes, bytes]:
    return tuple(zlib.compress(p.tobytes(), 1) for p in planes)


def repeated_bits(hashes: DataFrame, bits: int) -> bytes:
    """The second plane over all rows of the one column (long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            first, second = places(batch.column(0).to_numpy(zero_copy_only=False), bits)
            add(planes, np.concatenate([first, second[second != first]]))
        once, twice = pack(planes)
        yield pa.RecordBatch.from_arrays([pa.array([once], pa.binary()), pa.array([twice], pa.binary())], names=["once", "twice"])

    sketches = hashes.mapInArrow(run, "once binary, twice binary").rdd.map(lambda r: (bytes(r[0]), bytes(r[1])))
    empty = pack((np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)))
    return zlib.decompress(sketches.treeAggregate(empty, merge, merge, depth=3)[1])


def possibly_repeated(hashes: DataFrame, column: str, bits: int):
    """A function of a long column that tells whether its text may occur again."""
    plane = hashes.sparkSession.sparkContext.broadcast(repeated_bits(hashes.select(column), bits))

    @F.pandas_udf(T.BooleanType())
    def maybe(h: pd.Series) -> pd.Series:
        twice = np.frombuffer(plane.value, np.uint8)
        hit = np.ones(len(h), bool)
        for at in places(h.to_numpy(), bits):
            hit &= (twice[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return pd.Series(hit)

    return maybe


def digest(text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def ranges_for(rows: int, max_bits: int) -> int:
    return max(1, -(-rows * BITS_PER_ROW // max_bits))


def marked(rows: DataFrame, hashes: DataFrame, column: str, max_bits: int) -> DataFrame:
    """``rows`` with ``__vx_maybe``. ``hashes``: the materialised column (long) of all of them, which ``rows`` have too."""
    total = hashes.count()
    n = ranges_for(total, max_bits)
    if n == 1:
        return rows.withColumn("__vx_maybe", possibly_repeated(hashes, column, filter_bits(total, max_bits))(F.col(column)))
    own, out = F.pmod(F.xxhash64(F.lit(3), F.col(column)), F.lit(n)), []
    for k in range(n):
        maybe = possibly_repeated(hashes.where(own == k), column, max_bits)
        out.append(materialise(rows.where(own == k).withColumn("__vx_maybe", maybe(F.col(column))), "exact-marked"))
    return rows.sparkSession.read.schema(out[0].schema).parquet(*[x._vx_path for x in out])


def exact_groups(docs: DataFrame, text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document row: doc_id, keep_id, group_size, kept, text_sha256."""
    own = docs.select("doc_id", digest(text).alias("text_sha256"))
    own = materialise(own.withColumn("h", F.xxhash64("text_sha256")), "exact-digests")
    known = marked(own, own, "h", max_bits)
    through = known.where("not __vx_maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    # rows that repeat id and text are one until the end, so the join with the groups has nothing above it and may be split
    again = known.where("__vx_maybe").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n"))
    groups = again.groupBy(F.col("text_sha256").alias("__vx_sha")).agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    groups = materialise(groups, "exact-groups", narrow=True)  # written, so that both sides of the join are plain shuffles, which can be split
    joined = again.join(groups, F.col("text_sha256") == F.col("__vx_sha")).drop("__vx_sha").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    settled = joined.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("k") == 1))
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return through.select(columns).unionByName(settled.select(columns))


def drop_exact_duplicates(docs: DataFrame, text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The documents that stay, with their own columns; texts of unique rows are not shuffled."""
    hashes = materialise(docs.select(F.xxhash64(digest(text)).alias("__vx_h")), "exact-hashes")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__vx_row"), digest(text).alias("__vx_sha")).withColumn("__vx_h", F.xxhash64("__vx_sha"))
    known = marked(rows, hashes, "__vx_h", max_bits)
    unique = known.where("not __vx_maybe").select("__vx_row.*")
    again = known.where("__vx_maybe").groupBy("__vx_sha").agg(F.max_by("__vx_row", F.coalesce(F.col("__vx_row.doc_id"), F.lit(-(1 << 63)))).alias("__vx_row"))
    return unique.unionByName(again.select("__vx_row.*"))
