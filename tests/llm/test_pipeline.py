"""The pipeline against brute-force versions of its stages, one after the other."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import pytest
from test_operators import brute_components, brute_fill, brute_fingerprint, brute_lines, brute_quality, reference_ids, shuffled

import corpus_pipeline
from volumetrix.llm import mixing

#: Columns of documents, and some whose names operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, KEPT int, n_lines int, epochs int, `at.b` string"
SHARE = 0.8


def made(seed=4, n=2000):
    """Documents by id: plain ones, symbol runs, copies, near copies, shared lines, a long one, short and null ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(4))
    shared = [" ".join(word() for _ in range(12)) for _ in range(4)]
    plain = [" ".join(word() for _ in range(rng.randint(60, 140))) for _ in range(n)]
    for k in range(0, 60):
        plain[k] = plain[k] + "\n" + ("  " + shared[k % 4].upper() if k % 3 else shared[k % 4]) + "\n" + word()
    symbols = [" ".join(word() + "***" for _ in range(70)) for _ in range(200)]
    copies = [plain[100]] * 12 + [plain[k] for k in range(101, 110)]
    near = []
    for k in range(110, 140):
        words = plain[k].split(" ")
        words[rng.randrange(len(words))] = word()
        near.append(" ".join(words))
    odd = [None, "", "too short", "\n\n", "again and again " * 60, "\n".join(" ".join(word() for _ in range(9)) for _ in range(900))]
    texts = plain + symbols + copies + near + odd
    order = rng.sample(range(10 * len(texts)), len(texts))
    sources = [f"src{rng.choice([0, 0, 0, 1, 2, 3, 7])}" for _ in texts]
    langs = [rng.choice(["en", "en", "en", "en", None]) if k >= n + 200 else "en" for k in range(len(texts))]
    rows = {i: (t, la, s) for i, t, la, s in zip(order, texts, langs, sources)}
    marks = [(order[k], int(k < n), 0) for k in range(n + 200)]
    return rows, marks, {order[k] for k in range(n, n + 200)}


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    rows, marks, bad = made()
    at = str(tmp_path_factory.mktemp("pipeline"))
    full = [(i, t, la, s, len(t or ""), "h", 1, 2, 3, "x") for i, (t, la, s) in rows.items()]
    spark.createDataFrame(full, SCHEMA).repartition(5).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{at}/labels.parquet")
    return at, rows, bad


def brute_first_three(rows, bad):
    """doc_id to text of what quality rules, line dedup and near-dedup leave."""
    texts = {}
    for i, (t, _, _) in rows.items():
        n, _, _, _, repeats = brute_quality(t)
        if n >= 50 and 100 * repeats <= 50 * n and i not in bad:
            texts[i] = t
    lined = {i: text for i, _, _, text in brute_lines(list(texts.items()), 40, 5)}
    ids = sorted(lined)
    roots = brute_components([brute_fingerprint(lined[i]) for i in ids])
    return texts, lined, {i: lined[i] for i, root in zip(ids, roots) if ids[root] == i}


def test_stages(spark, case):
    """Each stage keeps what its brute-force version keeps, with the columns it was given."""
    at, rows, bad = case
    docs, wanted = spark.read.parquet(f"{at}/documents.parquet"), brute_first_three(rows, bad)
    assert all(len(a) > len(b) for a, b in ((rows, wanted[0]), (wanted[1], wanted[2]))) and wanted[0] != wanted[1]
    for k, ((_, stage), want) in enumerate(zip(corpus_pipeline.STAGES, wanted)):
        out = stage(spark, docs, at)
        assert out.columns == docs.columns
        out.write.parquet(f"{at}/stage-{k}")
        docs = spark.read.parquet(f"{at}/stage-{k}")
        got = docs.collect()
        assert {r.doc_id: r.text for r in got} == want and len(got) == len(want)
        assert all(r.n_chars == len(r.text) and (r.h, r.KEPT, r.n_lines, r.epochs, r["at.b"]) == ("h", 1, 2, 3, "x") for r in got)
    assert corpus_pipeline.STAGES[3][1](spark, docs, at).columns == docs.columns


def test_run(spark, case):
    """Whole run: the taken documents are prefixes of each source's order within its budget, packed whole."""
    at, rows, bad = case
    left = brute_first_three(rows, bad)[2]
    ids = {i: [*x, 0] for i, x in zip(left, reference_ids(left.values()))}
    out = corpus_pipeline.run(spark, at).collect()
    taken = {r.doc_id for r in out}

    want = {(i, p): (s, ids[i][s : s + 2048]) for i in taken for p, s in enumerate(range(0, len(ids[i]), 2048))}
    assert len(out) == len(want)
    bins = defaultdict(list)
    for r in out:
        start, part = want[r.doc_id, r.piece]
        assert (r.start, r.length, r.ids_crc32) == (start, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)))
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        ends = [0]
        for offset, n in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + n)
        assert ends[-1] <= 2048

    leaves = defaultdict(list)
    for i in left:
        _, lang, source = rows[i]
        leaves[mixing.DOMAINS[int(source[3:]) % len(mixing.DOMAINS)], lang or "", source].append(i)
    tree: dict = {}
    for (d, la, s), members in leaves.items():
        tree.setdefault(d, {}).setdefault(la, {})[s] = sum(len(ids[i]) for i in members)
    weights = lambda level, x: (mixing.DOMAIN_WEIGHTS.get(x, 0.0), mixing.LANG_WEIGHTS.get(x, 0.05), 1.0)[level]
    below = lambda t: sum(map(below, t.values())) if isinstance(t, dict) else t

    def spread(node, budget, path):
        names = list(node)
        for x, b in zip(names, brute_fill(budget, [below(node[x]) for x in names], [weights(len(path), x) for x in names])):
            yield from spread(node[x], int(b), (*path, x)) if isinstance(node[x], dict) else [((*path, x), b)]

    budgets = dict(spread(tree, int(below(tree) * SHARE), ()))
    assert any(below(tree[d][la][s]) > budgets[d, la, s] + 2 for d, la, s in budgets)
    for key, members in leaves.items():
        whole = int(budgets[key] >= sum(len(ids[i]) for i in members) - 4 and set(members) <= taken)
        order = sorted(members, key=lambda i: shuffled(spark, whole, i))
        n = sum(i in taken for i in order)
        assert all(i in taken for i in order[:n])
        used = sum(len(ids[i]) for i in order[:n])
        assert used <= budgets[key] + 1 and (n == len(order) or used + len(ids[order[n]]) > budgets[key] - 4)


def staged(spark, at, rows):
    """Rows after each stage, for documents given as (doc_id, text, lang, source)."""
    full = [(i, t, la, s, len(t or ""), "h", 1, 2, 3, "x") for i, t, la, s in rows]
    spark.createDataFrame(full, SCHEMA).coalesce(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(7, 1, 0), (7, 0, 0), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{at}/labels.parquet")
    docs, out = spark.read.parquet(f"{at}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, at).write.parquet(f"{at}/stage-{k}")
        docs = spark.read.parquet(f"{at}/stage-{k}")
        out.append(docs.collect())
    return out


def test_empty_tables(spark, tmp_path):
    assert staged(spark, str(tmp_path), []) == [[]] * 5


def test_null_and_repeated_ids(spark, tmp_path):
    """Rows without an id or with one id are told apart by their texts; equal rows are one; nulls in every column crash nothing."""
    rng = random.Random(3)
    a, b, c, d, e = (" ".join(str(rng.random()) for _ in range(60)) for _ in range(5))
    rows = [(None, a, "en", "src1"), (None, b, None, None), (7, c, "en", "src1"), (7, c, "en", "src1"), (7, d, "en", None), (8, None, None, None), (9, "", "en", "src1"), (10, e, "en", "src5"), (None, None, None, None)]
    quality, lined, near, mixed, packed = staged(spark, str(tmp_path), rows)
    pairs = lambda found: sorted((r.doc_id or 0, r.text) for r in found)
    assert pairs(quality) == pairs(lined) == sorted([(0, a), (0, b), (7, c), (7, c), (7, d), (10, e)])
    assert pairs(near) == sorted([(0, a), (0, b), (7, c), (7, d), (10, e)])
    assert 0 < len(mixed) <= len(near) and set(pairs(mixed)) <= set(pairs(near)) and len(packed) == len(mixed)
