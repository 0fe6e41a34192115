"""From raw documents to packed sequences: quality rules, line dedup, near-dedup, mixing, packing.

Every stage reads what the one before kept, written as Parquet. All but the last return the columns
of ``documents``; the last returns one row per packed piece.

Edge cases: empty tables pass through every stage as empty. Null and empty texts have no words and go
in the first stage. Rows without a doc_id, or with one doc_id and different texts, are told apart by
their texts; in the mixture they share one place in the order and are taken together or not at all.
Rows that repeat in full are near duplicates, of which one stays. Null languages and sources are a
stratum and a leaf of their own. Further columns, also those with names the operators use, pass
through untouched up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetrix.llm import line_dedup, mixing, packing, quality_rules, simhash_dedup
from volumetrix.llm.common import load, materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a certified cutoff go."""
    return quality_rules.quality_filter(docs, load(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 or more characters found in 5 or more documents stay in one of them; n_chars follows the text."""
    done = line_dedup.shorten(docs)
    return done.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else done


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays."""
    return simhash_dedup.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Target weights over domains, languages and sources; 80 % of the tokens, no document twice."""
    return mixing.mix(docs, budget_share=0.8, max_epochs=1)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("source mixture", mixture),
    ("best-fit packing", sequences),
]

#: The cutoffs, components and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
