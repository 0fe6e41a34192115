"""Path search: components of the text, last first, must be contained in the names up the chain.

A chain shorter than the text ends the comparison, and a record whose parent is missing has an empty
chain and matches every search (``strict`` leaves those out). The last component is tested before
any join, so only files whose own name holds it go up the chain, level by level: k joins to the
parents' side and plain ``contains`` on names. Records without a parent are one anti-join apart.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ROOT
from .tree import Tree, orphans


def parse(text: str) -> list[str]:
    """Non-empty components, last first."""
    return [x for x in re.split(r"[\\/]", text or "") if x][::-1]


def search(tree: Tree, text: str, strict: bool = False) -> DataFrame:
    """The files that match ``text``, with the columns of the files."""
    terms = parse(text)
    files, columns = tree.files, tree.files.columns
    if not terms:
        return files
    hit = F.col("name").contains(terms[0])
    rows = files.where(hit)
    if len(terms) > 1:
        rows = _above(tree, rows, terms[1:], strict).select(*columns)
    elif strict:
        ids = tree.inner.select(F.col("volume").alias("__uv"), F.col("mft_index").alias("__ui"))
        below = rows.where(F.col("parent") != ROOT).join(ids, (F.col("volume") == F.col("__uv")) & (F.col("parent") == F.col("__ui")), "left_semi")
        rows = rows.where(F.col("parent") == ROOT).unionByName(below)
    return rows if strict else rows.unionByName(orphans(files, tree.inner).where(~hit))


def _above(tree: Tree, rows: DataFrame, terms: list[str], strict: bool) -> DataFrame:
    """Rows whose parents' names hold the other terms, one join a level. A record is decided by the chain's end or its last term."""
    ids = tree.inner.select(F.col("volume").alias("__pv"), F.col("mft_index").alias("__pi"))
    up = tree.inner.join(ids, (F.col("volume") == F.col("__pv")) & (F.col("parent") == F.col("__pi")), "left")
    up = up.select(F.col("volume").alias("__uv"), F.col("mft_index").alias("__ui"), F.col("parent").alias("__up"), F.col("name").alias("__un"), ((F.col("parent") != ROOT) & F.col("__pi").isNull()).alias("__uo"))
    rows = rows.withColumn("__at", F.col("parent"))
    for k, term in enumerate(terms, 1):
        rows = rows.join(up, (F.col("volume") == F.col("__uv")) & (F.col("__at") == F.col("__ui")), "left")
        seen = F.when(F.col("__uo"), F.lit(True)).when(~F.col("__un").contains(term), F.lit(False)).when((F.col("__up") == ROOT) | F.lit(k == len(terms)), F.lit(True))
        if k == 1:
            seen = F.when(F.col("parent") == ROOT, F.lit(True)).when(F.col("__ui").isNull(), F.lit(not strict)).otherwise(seen)
        else:
            seen = F.coalesce("__found", seen)
        rows = rows.withColumn("__found", seen).where("__found is null or __found").withColumn("__at", F.when(F.col("__found").isNull(), F.col("__up"))).drop("__uv", "__ui", "__up", "__un", "__uo")
    return rows.where("__found")


def chain_matches(chain: Column, search_text: Column) -> Column:
    """The same rule for a chain (names, leaf first) and a text that are both columns."""
    terms = F.reverse(F.filter(F.split(search_text, r"[\\/]"), lambda x: x != ""))
    n = F.least(F.size(chain), F.size(terms))
    pairs = F.zip_with(F.slice(chain, F.lit(1), n), F.slice(terms, F.lit(1), n), lambda a, b: F.contains(a, b))
    return F.forall(pairs, lambda x: x)
