"""Streams with more pending renames than the bounded queue holds, and in batches, against their SQL and the fold."""

from __future__ import annotations

import duckdb
import pytest

from volumetrix.operators import changes
from volumetrix.plans.catalog import ORACLES, QUERIES
from volumetrix.schema import JOURNAL
from volumetrix.streaming import live

from test_changes import NEW, OLD, fold_journal, journal_rows

USERS = 2100


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Every user signs up, all old names come before the first new one, some twice; every seventh user ends or starts anew."""
    log = [(u, t) for t in ("signup", "click") for u in range(USERS)] + [(u, "click") for u in range(0, USERS, 50)] + [(u, "view") for u in range(USERS)]
    log += [(u, "error") for u in range(0, USERS, 7)] + [(u, "signup") for u in range(0, USERS, 14)] + [(u, "view") for u in range(0, USERS, 25)]
    path = tmp_path_factory.mktemp("sf")
    rows = [(n, u, t) for n, (u, t) in enumerate(log)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{path}/events.parquet")
    customers = [(u, f"Customer{u}", u % 25) for u in range(0, 2 * USERS, 3)]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int").write.parquet(f"{path}/customer.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["journal_stream", "live_stream_loaded", "live_stream"])
def test_no_pending_rename_is_forgotten(spark, sf, name):
    con = duckdb.connect()
    for table in ("events", "customer"):
        con.sql(f"create view {table} as select * from '{sf}/{table}.parquet/*.parquet'")
    df = QUERIES[name](spark, sf)
    want = con.sql(f"select {', '.join(df.columns)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


@pytest.mark.parametrize("pending", [None, 3])
def test_pending_renames_go_on_in_the_next_batch(spark, tmp_path, pending):
    """Batches of one file each: counts without a bound and the bounded queue both carry over."""
    rows = [("C", u, [OLD, NEW][u % 40 >= 20] if u % 3 else r[2], *r[3:]) for u, r in enumerate(journal_rows(11, n=240))]
    live.use_rocksdb(spark)
    query = None
    for n in range(3):
        spark.createDataFrame(rows[n * 80 : n * 80 + 80], JOURNAL).coalesce(1).write.mode("append").parquet(str(tmp_path / "j"))
        stream = spark.readStream.schema(JOURNAL).parquet(str(tmp_path / "j"))
        query = live.follow(stream, str(tmp_path / "out"), str(tmp_path / "ck"), {"availableNow": True}, pending=pending)
        query.awaitTermination()
    want, files = fold_journal([r for r in rows if r[2] & 0x3300], pending or len(rows))
    other, _ = fold_journal([r for r in rows if r[2] & 0x3300], 3 if pending is None else len(rows))
    assert want != other  # the bound matters here
    done = live.read_outcomes(spark, str(tmp_path / "out"))
    assert sorted((r.usn, r.op, r.mft_index, r.rejected) for r in done.collect()) == want
    assert {r.mft_index: (r.parent, r["name"], r["size"], r.is_directory) for r in live.snapshot(done).collect()} == files
