"""Keeping an index current from a journal stream.

Per volume, a stateful processor holds the table and the pending renames in the state store
(RocksDB), orders each batch by USN, and replays it record by record: the exact semantics, parents
included. It emits every change with its outcome. Renames wait in a queue of ``pending`` records that
forgets its oldest, or, with ``pending`` None, until their new name comes, however many wait.
``follow`` writes a folder of outcomes per batch and, every few batches, folds those since the last
snapshot into the next one, so that ``current`` reads one snapshot and a short tail, however long the
journal has run. ``outcomes`` folders stay for the rejects.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import storage
from ..operators.changes import RenameCounts, RenameQueue, events
from ..schema import FILES, PENDING_RENAMES, ROOT

OUTCOMES = "volume string, usn bigint, op string, mft_index bigint, parent bigint, name string, size bigint, is_directory boolean, rejected string"
#: Batches between two snapshots.
SNAPSHOT_EVERY = 20
#: Rows of a batch that are Python objects at a time.
CHUNK = 10_000
#: What the replay reads of a change.
ROW = pa.schema([("usn", pa.int64()), ("op", pa.string()), ("mft_index", pa.int64()), ("parent", pa.int64()), ("name", pa.string()), ("is_directory", pa.bool_())])
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Touched:
    """A map state of one batch: a record is read when first asked for and written once, if it changed."""

    def __init__(self, state):
        self.state, self.before, self.now = state, {}, {}

    def get(self, index: int) -> tuple | None:
        if index not in self.now:
            there = self.state.containsKey((index,))
            self.before[index] = self.now[index] = tuple(self.state.getValue((index,))) if there else None
        return self.now[index]

    def put(self, index: int, row: tuple | None) -> None:
        self.get(index)
        self.now[index] = row

    def write(self) -> None:
        for index, row in self.now.items():
            if row is None and self.before[index] is not None:
                self.state.removeKey((index,))
            elif row != self.before[index]:
                self.state.updateValue((index,), row)


class Replay(StatefulProcessor):
    def __init__(self, pending: int | None = PENDING_RENAMES):
        self.pending = pending

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.files = handle.getMapState("files", "mft_index bigint", "parent bigint, name string, size bigint, is_directory boolean")
        if self.pending is None:
            self.counts = handle.getMapState("waiting", "mft_index bigint", "n bigint")
        else:
            self.queue = handle.getListState("renames", "mft_index bigint")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.itertuples(index=False):
            self.files.updateValue((int(r.mft_index),), (int(r.parent), r.name, int(r.size), bool(r.is_directory)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pa.concat_tables(pa.Table.from_pandas(f[ROW.names], ROW, preserve_index=False) for f in rows).combine_chunks()
        order = pc.sort_indices(batch, [("usn", "ascending")])
        table, counts = Touched(self.files), Touched(self.counts) if self.pending is None else None
        queue = RenameCounts(counts) if self.pending is None else RenameQueue(self.pending, (r[0] for r in self.queue.get()))
        for at in range(0, len(order), CHUNK):
            out = []
            for usn, op, index, *row in zip(*(c.to_pylist() for c in batch.take(order[at : at + CHUNK]).columns)):
                if op == "old":
                    queue.push(index)
                elif op != "rename" or queue.take(index):
                    out.append((key[0], usn, op, index, *self.apply(table, op, index, *row)))
            yield pd.DataFrame(out, columns=["volume", "usn", "op", "mft_index", "parent", "name", "size", "is_directory", "rejected"], dtype=object)
        table.write()
        if counts is not None:
            counts.write()
        elif queue.waiting:
            self.queue.put([(index,) for index in queue.waiting])
        else:
            self.queue.clear()

    def apply(self, table: Touched, op: str, index: int, parent: int, name: str, directory: bool) -> tuple:
        """The record after the change (nulls if it is gone) and why the change was rejected, if it was."""
        there = table.get(index)
        if op == "delete":
            table.put(index, None)
            return None, None, None, None, None if there is not None else "absent"
        if op == "create" and there is not None:
            return *there, "occupied"
        if parent != ROOT and table.get(parent) is None:
            return parent, name, None, None, "no parent"
        if op == "rename" and there is None:
            return parent, name, None, None, "absent"
        row = (parent, name, there[2] if there else 0, there[3] if there else directory)
        table.put(index, row)
        return *row, None

    def close(self) -> None:
        return None


def outcomes(stream: DataFrame, initial: DataFrame | None = None, pending: int | None = PENDING_RENAMES) -> DataFrame:
    """Journal rows (batch schema) to one row per change with its outcome, starting from the table ``initial``."""
    found, start = events(stream).groupBy("volume"), None
    if initial is not None:
        start = initial.select("volume", "mft_index", "parent", "name", "size", "is_directory").groupBy("volume")
    return found.transformWithStateInPandas(Replay(pending), OUTCOMES, "Append", "None", initialState=start)


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def snapshot(applied: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """The table after all accepted changes: the last one of each record, unless it is a delete, and what ``initial`` has of others."""
    last = applied.where("rejected is null").groupBy("volume", "mft_index").agg(F.max_by(F.struct("op", "parent", "name", "size", "is_directory"), "usn").alias("r"))
    now = last.where("r.op <> 'delete'").select("volume", "mft_index", "r.parent", "r.name", "r.size", "r.is_directory")
    if initial is None:
        return now
    return initial.select(now.columns).join(last.select("volume", "mft_index"), ["volume", "mft_index"], "left_anti").unionByName(now)


def rejects(applied: DataFrame) -> DataFrame:
    return applied.where("rejected is not null").select("volume", "usn", "op", "mft_index", F.col("rejected").alias("reason"))


def follow(
    stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, refreshed: Callable[[int], None] | None = None, initial: DataFrame | None = None, snapshot_every: int = SNAPSHOT_EVERY,
    pending: int | None = PENDING_RENAMES,
) -> StreamingQuery:
    """Appends outcomes to Parquet under ``path``, a folder per batch so that a retried batch replaces itself.

    ``initial`` is the table the journal starts from, loaded into the state before the first batch and
    part of every snapshot. ``trigger`` defaults to one batch a second; ``refreshed`` is called with
    each batch number, once the batch is to be seen by ``current``. A checkpoint keeps to the kind of
    ``pending`` (a number, or None) it was begun with.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if (number + 1) % snapshot_every == 0:
            write_snapshot(batch.sparkSession, path, number, initial)
        if refreshed:
            refreshed(number)

    writer = outcomes(stream, initial, pending).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OUTCOMES + ", batch int").option("basePath", path).parquet(f"{path}/batch=*").drop("batch")


def snapshots(spark: SparkSession, path: str) -> list[int]:
    """Batches whose snapshot is whole, in order: its success marker is written last."""
    found = [int(x.split("=")[1]) for x in storage.folders(spark, f"{path}/snapshots") if x.startswith("upto=")]
    return sorted(n for n in found if storage.exists(spark, f"{path}/snapshots/upto={n}/_SUCCESS"))


def current(spark: SparkSession, path: str, initial: DataFrame | None = None, upto: int | None = None) -> DataFrame:
    """The table now (or after batch ``upto``): the last snapshot, and the outcomes of the batches since."""
    done = [n for n in snapshots(spark, path) if upto is None or n <= upto]
    base = spark.read.schema(FILES).parquet(f"{path}/snapshots/upto={done[-1]}") if done else initial
    batches = (int(x.split("=")[1]) for x in storage.folders(spark, path) if x.startswith("batch="))
    tail = [f"{path}/batch={n}" for n in sorted(batches) if n > (done[-1] if done else -1) and (upto is None or n <= upto)]
    if not tail:
        return base if base is not None else spark.createDataFrame([], FILES)
    return snapshot(spark.read.schema(OUTCOMES).parquet(*tail), base).select("volume", "mft_index", "parent", "name", "size", "is_directory")


def write_snapshot(spark: SparkSession, path: str, number: int, initial: DataFrame | None = None, keep: int = 2) -> None:
    """The table after batch ``number``, from the snapshot before it; readers of that one are not disturbed, older ones go."""
    before = [n for n in snapshots(spark, path) if n < number]
    current(spark, path, initial, number).write.mode("overwrite").parquet(f"{path}/snapshots/upto={number}")
    for n in before[: max(0, len(before) + 1 - keep)]:
        storage.remove(spark, f"{path}/snapshots/upto={n}")
