"""Paths and search against a plain walk, on the small forest and on random forests."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from volumetrix.operators import lookup, search, tree
from volumetrix.schema import FILES

FOREST = [(5, ".", 5), (10, "Users", 5), (11, "bob", 10), (12, "a.txt", 11), (13, "b.txt", 5), (20, "orph", 99), (21, "child", 20), (22, "gc", 21)]


def frame(spark, rows, volume="c"):
    return spark.createDataFrame([(volume, i, p, n, 1, False) for i, n, p in rows], FILES)


def chain(rows, i):
    by, out = {r[0]: r for r in rows}, []
    while True:
        _, name, parent = by[i]
        if parent == 5:
            return out + [name]
        if parent not in by:
            return out
        out.append(name)
        i = parent
        if len(out) > 100:
            return None


@pytest.mark.parametrize("directories_only", [False, True])
def test_paths_of_the_forest(spark, directories_only):
    df = frame(spark, FOREST).withColumn("is_directory", F.lit(True))
    paths = {r.mft_index: r.path for r in tree.full_paths(tree.Tree.of(df, directories_only)).collect()}
    assert paths == {5: "C:\\.", 10: "C:\\Users", 11: "C:\\Users\\bob", 12: "C:\\Users\\bob\\a.txt", 13: "C:\\b.txt", 20: "C:", 21: "C:\\child", 22: "C:\\child\\gc"}


@pytest.mark.parametrize("text, ids", [
    ("", [5, 10, 11, 12, 13, 20, 21, 22]), ("//", [5, 10, 11, 12, 13, 20, 21, 22]), ("txt", [12, 13, 20]), ("TXT", [20]), (".", [5, 12, 13, 20]), ("bob", [11, 20]), ("Users/bob", [11, 20]),
    ("C:\\Users\\bob", [11, 20]), ("bob/a", [12, 20]), ("zzz/b.txt", [13, 20]), ("Users/txt", [13, 20]), ("child/gc", [20, 22]), ("orph/child", [20, 21]),
])
def test_search_of_the_forest(spark, text, ids):
    own = tree.Tree.of(frame(spark, FOREST))
    assert sorted(r.mft_index for r in search.search(own, text).collect()) == ids
    if search.parse(text):
        assert 20 not in [r.mft_index for r in search.search(own, text, strict=True).collect()]


@pytest.mark.parametrize("seed", range(4))
def test_random_forests(spark, seed):
    rng = random.Random(seed)
    ids = rng.sample(range(6, 200), 60)
    rows = [(i, rng.choice("abc") + rng.choice("abc"), rng.choice([5, 5, *ids[: max(1, k)], 999])) for k, i in enumerate(ids)]
    rows = [r for r in rows if rng.random() < 0.9]
    df = frame(spark, rows)
    own = tree.Tree.of(df)
    chains = {i: chain(rows, i) for i, _, _ in rows}
    paths = {r.mft_index: r.path for r in tree.full_paths(own, max_depth=128).collect()}
    for i, c in chains.items():
        assert paths[i] == (None if c is None else "C:" + "".join("\\" + x for x in reversed(c)))
    known = spark.createDataFrame([(i, c) for i, c in chains.items() if c is not None], "i long, chain array<string>")
    for text in ("a", "b/a", "a\\c/b", "c/zz", "x:/a/b/c/a"):
        terms = search.parse(text)
        want = sorted(i for i, c in chains.items() if c is not None and all(t in n for t, n in zip(terms, c)))
        got = sorted(r.mft_index for r in search.search(own, text).collect() if chains[r.mft_index] is not None)
        assert got == want
        assert sorted(r.i for r in known.where(search.chain_matches(F.col("chain"), F.lit(text))).collect()) == want


def test_cycles_and_volumes(spark):
    rows = [(30, "x", 31), (31, "y", 30), (32, "z", 31), (5, ".", 5)]
    df = frame(spark, rows).unionByName(frame(spark, FOREST, "d"))
    paths = {(r.volume, r.mft_index): r.path for r in tree.full_paths(tree.Tree.of(df), max_depth=16).collect()}
    assert paths["c", 30] is None and paths["c", 32] is None and paths["d", 12] == "D:\\Users\\bob\\a.txt"
    assert sorted(r.mft_index for r in tree.orphans(df).collect()) == [20]


def test_lookups(spark):
    df = frame(spark, FOREST + [(30, "bob", 5)])
    assert lookup.find_by_name(df, "bob").first().mft_index == 11 and lookup.find_by_name(df, "nobody").count() == 0
    assert lookup.find_by_index(df, 13, "c").first().name == "b.txt" and lookup.find_by_index(df, 14).count() == 0
    assert lookup.count_files(df).first().n_files == 9 and lookup.count_slots(df, 40).first().n_slots == 40 and lookup.count_slots(df).first().n_slots == 31
    assert [r.mft_index for r in lookup.page(df, 2, 3).collect()] == [11, 12, 13]
