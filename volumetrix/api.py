"""The index of one or more volumes: search as you type, lookups, paging, refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .operators import lookup, search, tree
from .sources.journal import JournalSource
from .sources.mft import MftSource


def register_sources(spark: SparkSession) -> None:
    """Both formats, with the push-down of filters that ``fsjournal`` implements and Spark has off."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MftSource)
    spark.dataSource.register(JournalSource)


def build_index(spark: SparkSession, path: str, **geometry) -> "Index":
    """Index a volume image; take the journal's offset before calling, then replay from there."""
    register_sources(spark)
    return Index(spark.read.format("mft").options(path=path, **geometry).load().drop("torn"))


class Index:
    """An immutable snapshot. ``replaced`` gives the next one; the caller swaps."""

    def __init__(self, files: DataFrame, cache: bool = True):
        self.files = files.persist() if cache else files
        self.tree = tree.Tree.of(self.files).kept()

    def replaced(self, files: DataFrame) -> "Index":
        return Index(files)

    def close(self) -> None:
        self.files.unpersist()

    def matching(self, text: str, strict: bool = False) -> DataFrame:
        """Matching files, without their paths."""
        return search.search(self.tree, text, strict)

    def search(self, text: str, strict: bool = False) -> DataFrame:
        """mft_index, path, size of the matching files; paths are computed for them only."""
        return self.results(self.matching(text, strict))

    def results(self, rows: DataFrame) -> DataFrame:
        return tree.full_paths(self.tree, rows).select("volume", "mft_index", "path", "size")

    def page(self, text: str, offset: int, limit: int) -> DataFrame:
        """Rows ``offset`` onwards of the result in record order, paths for these alone."""
        return self.results(lookup.page(self.matching(text), offset, limit)).orderBy("mft_index")

    def count(self, text: str = "") -> int:
        return self.matching(text).count()

    def find_by_name(self, name: str) -> DataFrame:
        return lookup.find_by_name(self.files, name)

    def find_by_index(self, index: int) -> DataFrame:
        return lookup.find_by_index(self.files, index)
