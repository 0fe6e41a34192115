"""The change journal in batch: classification, rename pairing, replay, compaction.

The closed forms partition by record, so they scale with records; a single volume's log need not
pass through one task. What depends on the whole log's order (the bounded rename queue, parents that
come and go) is the sequential ``fold`` per volume.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.bits import classify_reason, is_directory, record_number
from ..schema import CHANGES, PENDING_RENAMES, ROOT


def events(journal: DataFrame) -> DataFrame:
    """volume, usn, op (old, create, delete, rename), mft_index, parent, name, is_directory; other records dropped."""
    return journal.select(
        "volume", "usn", classify_reason(F.col("reason")).alias("op"), record_number(F.col("file_ref")).alias("mft_index"), record_number(F.col("parent_ref")).alias("parent"), "name",
        is_directory(F.col("file_attributes")).alias("is_directory"),
    ).where("op is not null")


def pair_renames(found: DataFrame) -> DataFrame:
    """Renames whose old name is still queued, for an unbounded queue.

    With b the running count of old minus new names of a record, a new name finds an old one exactly
    when b does not fall below zero and all its earlier values.
    """
    own = Window.partitionBy("volume", "mft_index").orderBy("usn")
    side = found.where(F.col("op").isin("old", "rename"))
    b = F.sum(F.when(F.col("op") == "old", 1).otherwise(-1)).over(own.rowsBetween(Window.unboundedPreceding, 0))
    low = F.least(F.lit(0), F.min("__b").over(own.rowsBetween(Window.unboundedPreceding, -1)))
    return side.withColumn("__b", b).withColumn("__low", low).where("op = 'rename' and __b >= __low").drop("__b", "__low")


def changes(journal: DataFrame, pending: int | None = None) -> DataFrame:
    """Creates, deletes and matched renames. ``pending`` bounds the rename queue (then per volume in order)."""
    found = events(journal)
    rest = found.where(F.col("op").isin("create", "delete"))
    return rest.unionByName(pair_renames(found) if pending is None else pair_renames_bounded(found, pending))


def pair_renames_bounded(found: DataFrame, pending: int = PENDING_RENAMES) -> DataFrame:
    """Renames matched through a queue of ``pending`` records that forgets its oldest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("usn", kind="stable")
        queue, hit = RenameQueue(pending), []
        for op, index in zip(pdf["op"], pdf["mft_index"]):
            if op == "old":
                queue.push(index)
            hit.append(op == "rename" and queue.take(index))
        return pdf[hit]

    side = found.where(F.col("op").isin("old", "rename"))
    return side.groupBy("volume").applyInPandas(run, CHANGES).select(*found.columns)


class RenameQueue:
    """Records waiting for their new name: first in, first matched, first forgotten."""

    def __init__(self, capacity: int = PENDING_RENAMES, waiting: Iterable[int] = ()):
        self.capacity, self.waiting = capacity, deque(waiting)

    def push(self, index: int) -> None:
        if len(self.waiting) >= self.capacity:
            self.waiting.popleft()
        self.waiting.append(index)

    def take(self, index: int) -> bool:
        try:
            self.waiting.remove(index)
        except ValueError:
            return False
        return True


class RenameCounts:
    """Records waiting for their new name, none forgotten: how often each waits is all that counts. ``store`` holds that by record."""

    def __init__(self, store):
        self.store = store

    def push(self, index: int) -> None:
        self.store.put(index, ((self.store.get(index) or (0,))[0] + 1,))

    def take(self, index: int) -> bool:
        waiting = self.store.get(index)
        if waiting is None:
            return False
        self.store.put(index, (waiting[0] - 1,) if waiting[0] > 1 else None)
        return True


class Fold:
    """Sequential replay onto a table of records, with every guard."""

    def __init__(self, files: dict[int, tuple] | None = None):
        self.files = {} if files is None else files  # mft_index -> parent, name, size, is_directory

    def apply(self, op: str, index: int, parent, name, directory) -> str | None:
        """None if applied, else why not."""
        if op == "delete":
            return None if self.files.pop(index, None) is not None else "absent"
        if op == "create" and index in self.files:
            return "occupied"
        if parent not in self.files and parent != ROOT:
            return "no parent"
        if op == "create":
            self.files[index] = (parent, name, 0, bool(directory))
        elif index in self.files:
            self.files[index] = (parent, name, *self.files[index][2:])
        else:
            return "absent"
        return None


def replay_ordered(applied: Iterable[tuple], files: dict[int, tuple] | None = None) -> Iterator[tuple]:
    """Replays (usn, op, mft_index, parent, name, is_directory) and yields each with its outcome."""
    fold = Fold(files)
    for usn, *change in applied:
        yield usn, *change, fold.apply(*change)


def final_state(log: DataFrame) -> DataFrame:
    """Records that exist after the log (no parent guard): volume, mft_index, parent, name, is_directory, usn of the create.

    A record exists if a create follows its last delete; the first such create counts, later ones
    are rejected; name and parent are those of the last rename after it. Rows of a snapshot enter
    as creates before the log. One shuffle by record serves window and aggregation.
    """
    own = Window.partitionBy("volume", "mft_index")
    last_delete = F.max(F.when(F.col("op") == "delete", F.col("usn"))).over(own)
    alive = log.withColumn("__last", last_delete).where("__last is null or usn > __last")
    born = F.min(F.when(F.col("op") == "create", F.col("usn"))).over(own)
    alive = alive.withColumn("__born", born).where("__born is not null and usn >= __born and (usn = __born or op = 'rename')")
    row = lambda c: F.max_by(c, "usn").alias(c)
    return alive.groupBy("volume", "mft_index").agg(row("parent"), row("name"), F.min_by("is_directory", "usn").alias("is_directory"), F.min("usn").alias("created"))


def rejected_creates(log: DataFrame) -> DataFrame:
    """Creates on an occupied slot: all but the first between two deletes."""
    own = Window.partitionBy("volume", "mft_index").orderBy("usn")
    some = log.where(F.col("op").isin("create", "delete")).withColumn("__n", F.sum((F.col("op") == "delete").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    nth = F.row_number().over(Window.partitionBy("volume", "mft_index", "__n", "op").orderBy("usn"))
    return some.withColumn("__k", nth).where("op = 'create' and __k > 1").select("volume", "usn", "op", "mft_index", F.lit("occupied").alias("reason"))


def with_static_parents(log: DataFrame, files: DataFrame) -> DataFrame:
    """Changes whose parent is a known record or the root; deletes need none."""
    ids = files.select(F.col("volume").alias("pv"), F.col("mft_index").alias("pi"))
    free = (F.col("op") == "delete") | (F.col("parent") == ROOT)
    guarded = log.where(~free).join(ids, (F.col("volume") == F.col("pv")) & (F.col("parent") == F.col("pi")), "left_semi")
    return log.where(free).unionByName(guarded)


def compact(log: DataFrame) -> DataFrame:
    """Leaves out each create that its record's next create or delete deletes, and that delete.

    For logs in which creates find their slot empty; replaying the log as it is needs no such promise.
    """
    own = Window.partitionBy("volume", "mft_index", F.col("op").isin("create", "delete")).orderBy("usn")
    here, after, before = F.col("op"), F.lead("op").over(own), F.lag("op").over(own)
    gone = ((here == "create") & F.coalesce(after == "delete", F.lit(False))) | ((here == "delete") & F.coalesce(before == "create", F.lit(False)))
    return log.withColumn("__gone", gone).where("not __gone").drop("__gone")


def apply_deletes(files: DataFrame, deleted: DataFrame) -> DataFrame:
    """Clears the deleted records only; what lay below them is orphaned."""
    return files.join(deleted.select("volume", "mft_index").distinct(), ["volume", "mft_index"], "left_anti")
