"""Journal: classification, closed forms against the sequential fold, stream against batch."""

from __future__ import annotations

import random

import pytest

from volumetrix.functions.bits import classify_reason
from volumetrix.operators import changes
from volumetrix.schema import CHANGES, FILES, JOURNAL
from volumetrix.sources.journal import JournalSource
from volumetrix.streaming import live

CREATE, DELETE, OLD, NEW, CLOSE = 0x100, 0x200, 0x1000, 0x2000, 0x80000000


def log(spark, rows):
    return spark.createDataFrame([("C", u, op, i, 5, f"n{u}", False) for u, (op, i) in enumerate(rows)], CHANGES)


def journal_rows(seed, n=300, ids=8):
    rng = random.Random(seed)
    kinds = [CREATE, CREATE | CLOSE, DELETE, DELETE | CLOSE, OLD, NEW, NEW | CLOSE, CREATE | DELETE, CLOSE, 0x2]
    return [("C", u, rng.choice(kinds), (3 << 48) | rng.randint(10, 10 + ids), rng.choice([5, 5, 11, 12, (1 << 48) | 13]), rng.choice([0, 0x10]), f"n{u}") for u in range(n)]


def fold_journal(rows, pending=2000, files=None):
    """The whole journal, one record at a time, from the table ``files`` on."""
    queue, fold, out = changes.RenameQueue(pending), changes.Fold(files), []
    for _, usn, reason, ref, parent, attributes, name in rows:
        index, parent = ref & (1 << 48) - 1, parent & (1 << 48) - 1
        if reason & OLD:
            queue.push(index)
            continue
        op = "create" if reason & CREATE == reason else "delete" if reason & DELETE else "rename" if reason & NEW else None
        if op is None or op == "rename" and not queue.take(index):
            continue
        out.append((usn, op, index, fold.apply(op, index, parent, name, attributes & 0x10)))
    return out, fold.files


def test_classification(spark):
    cases = [(CREATE, "create"), (0, "create"), (CREATE | CLOSE, None), (CREATE | DELETE, "delete"), (DELETE | NEW, "delete"), (OLD | DELETE, "old"), (OLD | NEW, "old"), (NEW | CLOSE, "rename"), (CLOSE, None)]
    df = spark.createDataFrame([(r,) for r, _ in cases], "r long")
    assert [x[0] for x in df.select(classify_reason(df.r)).collect()] == [w for _, w in cases]


@pytest.mark.parametrize("seed", range(3))
def test_rename_pairing(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["old", "rename"]), rng.randint(1, 5)) for _ in range(200)]
    df = log(spark, rows)
    for pending in (2000, 3, 1):
        queue, want = changes.RenameQueue(pending), []
        for u, (op, i) in enumerate(rows):
            if op == "old":
                queue.push(i)
            elif queue.take(i):
                want.append(u)
        assert sorted(r.usn for r in changes.pair_renames_bounded(df, pending).collect()) == want
        if pending == 2000:
            assert sorted(r.usn for r in changes.pair_renames(df).collect()) == want


@pytest.mark.parametrize("seed", range(3))
def test_replay_closed_forms(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["create", "create", "delete", "rename"]), rng.randint(1, 12)) for _ in range(150)]
    df = log(spark, rows)
    outcome = list(changes.replay_ordered((u, op, i, 5, f"n{u}", False) for u, (op, i) in enumerate(rows)))
    fold = changes.Fold()
    for u, (op, i) in enumerate(rows):
        fold.apply(op, i, 5, f"n{u}", False)
    assert {r.mft_index: r["name"] for r in changes.final_state(df).collect()} == {i: f[1] for i, f in fold.files.items()}
    assert sorted(r.usn for r in changes.rejected_creates(df).collect()) == [x[0] for x in outcome if x[1] == "create" and x[-1] == "occupied"]


def test_guards_and_compaction(spark):
    fold = changes.Fold({10: (5, "d", 7, True)})
    assert fold.apply("create", 10, 5, "x", False) == "occupied" and fold.apply("create", 11, 99, "x", False) == "no parent"
    assert fold.apply("create", 11, 10, "f", False) is None and fold.apply("rename", 10, 5, "e", False) is None and fold.files[10] == (5, "e", 7, True)
    assert fold.apply("rename", 12, 5, "x", False) == "absent" and fold.apply("rename", 11, 98, "x", False) == "no parent"
    assert fold.apply("delete", 10, None, None, None) is None and 11 in fold.files and fold.apply("delete", 500, None, None, None) == "absent"
    for rows, left in (([("create", 1), ("delete", 1)], []), ([("rename", 8), ("rename", 9), ("create", 1), ("delete", 1)], [0, 1]), ([("create", 1), ("create", 2), ("delete", 2), ("delete", 1)], []), ([("create", 1), ("delete", 1), ("create", 1), ("delete", 1)], []), ([("delete", 1), ("create", 1)], [0, 1])):
        assert sorted(r.usn for r in changes.compact(log(spark, rows)).collect()) == left
    files = spark.createDataFrame([("C", 10)], "volume string, mft_index long")
    df = spark.createDataFrame([("C", 0, "create", 1, 10, "a", False), ("C", 1, "create", 2, 11, "b", False), ("C", 2, "create", 3, 5, "c", False), ("C", 3, "delete", 4, None, None, False)], CHANGES)
    assert sorted(r.usn for r in changes.with_static_parents(df, files).collect()) == [0, 2, 3]


def test_journal_source_in_batch(spark, tmp_path):
    rows = journal_rows(1)
    spark.createDataFrame(rows, JOURNAL).repartition(3).write.parquet(str(tmp_path / "j"))
    spark.dataSource.register(JournalSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("fsjournal").option("path", str(tmp_path / "j")).load()
    want = [r[1] for r in rows if r[2] & 0x3300]
    assert sorted(r.usn for r in df.collect()) == want
    assert sorted(r.usn for r in df.where("usn >= 100 and volume = 'C' and name <> 'n120'").collect()) == [u for u in want if u >= 100 and u != 120]
    assert df.where("volume = 'D'").count() == 0


@pytest.mark.parametrize("per_batch", [1000, 60])
def test_stream_equals_fold(spark, tmp_path, per_batch):
    rows = journal_rows(per_batch)
    spark.createDataFrame(rows, JOURNAL).coalesce(2).write.parquet(str(tmp_path / "j"))
    spark.dataSource.register(JournalSource)
    live.use_rocksdb(spark)
    stream = spark.readStream.format("fsjournal").options(path=str(tmp_path / "j"), startingUsn="earliest", maxPerBatch=per_batch).load()
    seen: list[int] = []
    query = live.follow(stream, str(tmp_path / "out"), str(tmp_path / "ck"), {"processingTime": "0 seconds"}, seen.append, snapshot_every=2)
    try:
        for _ in range(200):
            query.processAllAvailable()
            done = live.read_outcomes(spark, str(tmp_path / "out"))
            if query.lastProgress and query.lastProgress["sources"][0]["endOffset"] and str(len(rows)) in str(query.lastProgress["sources"][0]["endOffset"]):
                break
    finally:
        query.stop()
    want, files = fold_journal([r for r in rows if r[2] & 0x3300])
    assert sorted((r.usn, r.op, r.mft_index, r.rejected) for r in done.collect()) == want
    assert {r.mft_index: (r.parent, r["name"], r["size"], r.is_directory) for r in live.snapshot(done).collect()} == files
    assert live.rejects(done).count() == sum(x[3] is not None for x in want)
    assert len(seen) >= len(rows) // per_batch
    now = live.current(spark, str(tmp_path / "out"))
    assert {r.mft_index: (r.parent, r["name"], r["size"], r.is_directory) for r in now.collect()} == files
    kept = live.snapshots(spark, str(tmp_path / "out"))
    assert kept == [n for n in seen if n % 2 == 1][-2:]


def test_current_table_reads_a_snapshot_and_the_tail(spark, tmp_path):
    """However many batches there are, files of the last snapshot and of the batches after it are read; a snapshot without its marker is not."""
    path = str(tmp_path / "out")
    initial = spark.createDataFrame([("C", 1, 5, "kept", 3, False), ("C", 2, 5, "gone", 3, False)], FILES)
    for n in range(23):
        row = [("C", n, "create", 100 + n, 5, f"f{n}", 0, False, None), ("C", n, "create", 100, 5, "again", 0, False, "occupied")] + ([("C", n, "delete", 2, None, None, None, None, None)] if n == 4 else [])
        spark.createDataFrame(row, live.OUTCOMES).coalesce(1).write.parquet(f"{path}/batch={n}")
        if n % 10 == 9:
            live.write_snapshot(spark, path, n, initial)
    now = live.current(spark, path, initial)
    assert sorted((r.mft_index, r["name"]) for r in now.collect()) == [(1, "kept"), *((100 + n, f"f{n}") for n in range(23))]
    read = {f.split("/out/")[1].rsplit("/", 1)[0] for f in now.inputFiles()}
    assert read == {"snapshots/upto=19", "batch=20", "batch=21", "batch=22"} and live.snapshots(spark, path) == [9, 19]
    (tmp_path / "out/snapshots/upto=19/_SUCCESS").unlink()
    assert live.current(spark, path, initial).count() == 24 and live.current(spark, path, initial, upto=3).count() == 6
    live.write_snapshot(spark, path, 19, initial)
    live.write_snapshot(spark, path, 22, initial)
    assert live.snapshots(spark, path) == [19, 22] and live.current(spark, path).count() == 24


def test_stream_starts_from_a_table(spark, tmp_path):
    """Records of the loaded table take creates, renames and deletes like those the journal made."""
    rows = journal_rows(7)
    start = {i: (5, f"old{i}", 10 * i, i % 2 == 0) for i in range(9, 15)} | {900: (5, "untouched", 1, False), 901: (900, "kept", 2, False)}
    initial = spark.createDataFrame([("C", i, *f) for i, f in start.items()] + [("D", 1, 5, "other", 3, False)], FILES)
    spark.createDataFrame(rows, JOURNAL).coalesce(2).write.parquet(str(tmp_path / "j"))
    live.use_rocksdb(spark)
    stream = spark.readStream.schema(JOURNAL).parquet(str(tmp_path / "j"))
    live.follow(stream, str(tmp_path / "out"), str(tmp_path / "ck"), {"availableNow": True}, initial=initial).awaitTermination()
    done = live.read_outcomes(spark, str(tmp_path / "out"))
    want, files = fold_journal([r for r in rows if r[2] & 0x3300], files=dict(start))
    assert sorted((r.usn, r.op, r.mft_index, r.rejected) for r in done.collect()) == want
    got = {(r.volume, r.mft_index): (r.parent, r["name"], r["size"], r.is_directory) for r in live.snapshot(done, initial).collect()}
    assert got == {("C", i): f for i, f in files.items()} | {("D", 1): (5, "other", 3, False)}
