"""Parent pointers to paths.

Only records that some record names as parent (mostly directories, far fewer than files) are walked,
by pointer doubling: log2(depth) joins over that small side, each round written to the shared folder. Every record then needs one join to its
parent's path. A record whose parent is missing, other than the root's children, ends a chain and
adds no name to it, so an orphan's path is the drive alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..schema import ROOT
from ..storage import materialise

MAX_DEPTH = 1024


@dataclass(frozen=True)
class Tree:
    """The files and the records among them that are somebody's parent (volume, mft_index, parent, name)."""

    files: DataFrame
    inner: DataFrame

    @staticmethod
    def of(files: DataFrame, directories_only: bool = False) -> "Tree":
        """``directories_only`` trusts that parents are directories, which saves finding them."""
        narrow = files.select("volume", "mft_index", "parent", "name")
        if directories_only:
            return Tree(files, files.where("is_directory").select("volume", "mft_index", "parent", "name"))
        parents = files.select("volume", F.col("parent").alias("mft_index")).distinct()
        return Tree(files, narrow.join(parents, ["volume", "mft_index"], "left_semi"))

    def kept(self) -> "Tree":
        """The tree with its inner side written once, for the joins of a search and of the paths."""
        return Tree(self.files, materialise(self.inner, "tree-inner"))


def inner_paths(tree: Tree, max_depth: int = MAX_DEPTH) -> DataFrame:
    """volume, mft_index, path (backslash before every name, empty for an orphan), complete.

    ``complete`` is false for a chain deeper than ``max_depth``, which a cycle always is.
    """
    inner = tree.inner
    up = inner.select(F.col("volume").alias("pv"), F.col("mft_index").alias("pi"))
    known = inner.join(up, (F.col("volume") == F.col("pv")) & (F.col("parent") == F.col("pi")), "left")
    at_root = F.col("parent") == ROOT
    listed = at_root | F.col("pi").isNotNull()
    step = known.select(
        "volume", "mft_index", F.when(listed, F.concat(F.lit("\\"), "name")).otherwise("").alias("path"), F.when(~at_root & F.col("pi").isNotNull(), F.col("parent")).alias("ptr")
    )
    (step, going), reach = _written(step), 1
    while reach < max_depth and going:
        higher = step.select(F.col("volume").alias("pv"), F.col("mft_index").alias("pi"), F.col("path").alias("head"), F.col("ptr").alias("next"))
        step = step.join(higher, (F.col("volume") == F.col("pv")) & (F.col("ptr") == F.col("pi")), "left").select(
            "volume", "mft_index", F.concat(F.coalesce("head", F.lit("")), "path").alias("path"), F.col("next").alias("ptr")
        )
        step, going = _written(step)
        reach *= 2
    return step.select("volume", "mft_index", "path", F.col("ptr").isNull().alias("complete"))


def _written(step: DataFrame) -> tuple[DataFrame, int]:
    """The round's rows, and how many of them go on, counted while they are written."""
    seen = Observation()
    out = materialise(step.observe(seen, F.count("ptr").alias("going")), "tree-paths")
    return out, seen.get["going"]


def drive(volume: Column) -> Column:
    return F.concat(F.upper(volume), F.lit(":"))


def full_paths(tree: Tree, rows: DataFrame | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``rows`` (default: all files) with their path. Rows on a cycle or too deep have a null path."""
    rows = tree.files if rows is None else rows
    above = inner_paths(tree, max_depth).select(F.col("volume").alias("pv"), F.col("mft_index").alias("pi"), F.col("path").alias("head"), "complete")
    joined = rows.join(above, (F.col("volume") == F.col("pv")) & (F.col("parent") == F.col("pi")) & (F.col("parent") != ROOT), "left")
    own = F.concat(F.lit("\\"), "name")
    path = F.when(F.col("parent") == ROOT, own).when(F.col("pi").isNull(), "").when(F.col("complete"), F.concat("head", own))
    return joined.withColumn("path", F.concat(drive(F.col("volume")), path)).drop("pv", "pi", "head", "complete")


def orphans(files: DataFrame, inner: DataFrame | None = None) -> DataFrame:
    """Rows whose parent is missing and not the root. ``inner`` (of a ``Tree``) holds every parent there is, and is far smaller than the files."""
    ids = (files if inner is None else inner).select(F.col("volume").alias("pv"), F.col("mft_index").alias("pi"))
    return files.where(F.col("parent") != ROOT).join(ids, (F.col("volume") == F.col("pv")) & (F.col("parent") == F.col("pi")), "left_anti")
