"""Sum-of-squares packing into sequences of a fixed number of tokens.

A sum-of-squares packer keeps N(g), the number of open bins with gap g, and puts each piece where
the sum of N(g)^2 becomes smallest. Pieces of full length are sequences of their own. The rest is
dealt by a hash into shards of about ``SHARD_ROWS`` rows, each packed by itself, so that no task
grows with the input; a shard leaves few bins unfilled, which at its size is a small share. Ids are
those the tokenizer gives, strings of its added tokens included.

Edge cases: a null or empty text is its end id alone. Repeated rows are packed each, and spread over shards. A null doc_id
is packed like any other. An empty table gives no sequences. Other columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise
from .token_encoder import VOCABULARY, encoder, vocabulary_path

LENGTH, END_ID, SHARD_ROWS = 2048, 0, 16_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces; map-only."""
    path = vocabulary_path(vocabulary)
    bounded_batches(docs)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist())):
                data = ids.astype("<u4", copy=False).tobytes() + end
                for k, at in enumerate(range(0, len(data), 4 * length)):
                    part = data[at : at + 4 * length]
                    for column, x in zip(rows, (doc, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return own.mapInArrow(run, PIECES)


def sum_of_squares(lengths: list[int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, taken in the order given.

    Moving a bin from gap g to g - n changes the sum by (2 N(g - n) + 1) - (2 N(g) - 1), with no
    first term when the bin becomes full; a new bin counts as one whose gap is not counted.
    """
    count = np.zeros(size + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for k, n in enumerate(lengths):
        gaps = np.flatnonzero(count[n:]) + n  # gaps that hold the piece
        cost = 2 - 2 * count[gaps] + 2 * count[gaps - n]
        if len(gaps) and gaps[0] == n:
            cost[0] = 1 - 2 * count[n]
        fresh = 2 * count[size - n] + 1 if n < size else 0
        best = int(cost.argmin()) if len(gaps) else -1
        if best < 0 or fresh < cost[best]:
            at, gap, made = made, size, made + 1
        else:
            gap = int(gaps[best])
            at = open_bins[gap].pop()
            count[gap] -= 1
        bins[k], offsets[k] = at, size - gap
        if gap > n:
            open_bins[gap - n].append(at)
            count[gap - n] += 1
    return bins, offsets


def pack(parts: DataFrame, length: int = LENGTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Adds sequence_id and offset. ``parts``: materialised pieces."""
    shards = max(1, -(-parts.count() // shard_rows))
    # the place of a row in the written pieces spreads rows that repeat in full, and is the same when a task is run again
    key = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        bins, offsets = sum_of_squares(pdf["length"].tolist(), length)
        return pdf.assign(sequence_id=pdf["shard"].to_numpy() * (1 << 32) + bins, offset=offsets).drop(columns="shard")

    return parts.withColumn("shard", key.cast("long")).groupBy("shard").applyInPandas(run, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, text: str = "text", vocabulary: str = VOCABULARY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    return pack(materialise(pieces(docs, length, end_id, text, vocabulary), "pieces", narrow=True), length, shard_rows)
