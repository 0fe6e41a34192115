"""Exact length histogram: documents by encoded length, and suffix sums for every context limit.

Edge cases: a null or empty text has no ids (its length is the number of end ids added). Repeated
rows count each. An empty table has an empty histogram. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, materialise
from .token_encoder import VOCABULARY, encoder, vocabulary_path

#: Lengths that share a chunk of the two-level suffix sums.
CHUNK = 1024


def token_lengths(docs: DataFrame, *keep: Column, text: str = "text", vocabulary: str = VOCABULARY, end_ids: int = 0) -> DataFrame:
    """``keep`` columns plus n_tokens (long); map-only."""
    bounded_batches(docs)
    own = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__vx_text"))
    kept = own.schema.fields[:-1]
    path = vocabulary_path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            n = [len(ids) + end_ids for ids in enc.encode(batch.column(len(kept)).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(n, pa.int64())], names=[f.name for f in kept] + ["n_tokens"])

    return own.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["n_tokens long"]))


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, end_ids: int = 0) -> DataFrame:
    """length, n_docs."""
    return token_lengths(docs, text=text, vocabulary=vocabulary, end_ids=end_ids).groupBy(F.col("n_tokens").alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """One row per length L that occurs, read as a context limit.

    docs_at_least and tokens_at_least cover documents of length L or more; total_tokens covers all;
    truncated_tokens is the total when every document is cut to L; share_within is the share of
    documents that fit, so the q-quantile of lengths is the smallest L with share_within >= q.
    Between two neighbouring lengths truncated_tokens is linear, which answers every other limit.
    Sums run inside chunks of lengths and over chunk totals, so no task needs all lengths.
    """
    hist = histogram.withColumn("chunk", F.floor(F.col("length") / CHUNK)).withColumn("t", F.col("length") * F.col("n_docs"))
    totals = hist.groupBy("chunk").agg(F.sum("n_docs").alias("cn"), F.sum("t").alias("ct"))
    over = Window.orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    totals = totals.select(
        "chunk", F.coalesce(F.sum("cn").over(over), F.lit(0)).alias("above_n"), F.coalesce(F.sum("ct").over(over), F.lit(0)).alias("above_t"),
        F.sum("cn").over(everything).alias("total_docs"), F.sum("ct").over(everything).alias("total_tokens"),
    )
    inside = Window.partitionBy("chunk").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    out = hist.withColumn("in_n", F.sum("n_docs").over(inside)).withColumn("in_t", F.sum("t").over(inside)).join(totals, "chunk")
    n, t = F.col("in_n") + F.col("above_n"), F.col("in_t") + F.col("above_t")
    return out.select(
        "length", "n_docs", n.alias("docs_at_least"), t.alias("tokens_at_least"), "total_docs", "total_tokens",
        (F.col("total_tokens") - t + F.col("length") * n).alias("truncated_tokens"),
        ((F.col("total_docs") - n + F.col("n_docs")) / F.col("total_docs")).alias("share_within"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """limit, truncated_tokens, docs_over for any context limits: one pass over the suffix sums, of which each limit takes those above it."""
    over = lambda c, x: F.coalesce(F.max(F.when(F.col("length") > c, F.col(x))), F.lit(0))
    total = F.coalesce(F.max("total_tokens"), F.lit(0))
    rows = [F.struct(F.lit(int(c)).cast("long").alias("limit"), (total - over(c, "tokens_at_least") + c * over(c, "docs_at_least")).alias("truncated_tokens"), over(c, "docs_at_least").alias("docs_over")) for c in limits]
    return sums.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def token_counts(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, end_ids: int = 0) -> DataFrame:
    return suffix_sums(materialise(length_histogram(docs, text, vocabulary, end_ids), "lengths"))
