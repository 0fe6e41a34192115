"""SimHash near-duplicates through pivot distance tables.

Fingerprints: 64 bits, each the majority over the XXH64 hashes of a text's 4-word shingles. Each
distinct fingerprint (copies collapse first) gets, once, a table row of Hamming distances to
``PIVOTS`` fixed reference fingerprints, which goes with it from then on. By the triangle inequality
a pair whose rows differ by more than the threshold in any coordinate cannot link; such pairs are
discarded before their bits are looked at, and XOR verifies the survivors. ``figures`` tells how
many pairs were met, survived the rows and linked.

In 64 random bits distances to a pivot crowd around 32, so cells of pivot distances alone would let
nearly every pair meet. Pairs therefore meet in groups that agree on 2 of 6 bit blocks (3 of 7 and
so on for more fingerprints): 4 differing bits touch at most 4 blocks, so no link is lost. A large
group is searched breadth-first over its unvisited members, which emits at most one edge per member
and compares a dense group about once. Groups beyond ``GROUP_ROWS`` are streamed past, not gathered;
their fingerprints link through all values within half the threshold of them, which is exact, linear
in the group and needs no comparison that a pivot could spare.

Edge cases: null and wordless texts have fingerprint zero and link like any other; fewer than four
words are one shingle. Repeated rows get one component. A null doc_id never names a component unless
all ids in it are null; ``keep_one`` then keeps one of its rows. An empty table gives an empty result. Other columns pass ``keep_one`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, discard, materialise

WORDS, SEED, BITS, THRESHOLD = 4, 42, 64, 4
#: Blocks and how many of them agree in a candidate group, by growing number of distinct fingerprints.
SCHEMES = ((6, 2), (7, 3), (8, 4), (9, 5))
PIVOTS, PIVOT_SEED = 16, 20240501
GROUP_ROWS = 50_000
#: Ids of lost rows up to which they are broadcast (8 bytes each, far from what memory holds).
BROADCAST_LOST = 2_000_000


def shingle_hashes(text: bytes, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    from xxhash import xxh64_intdigest

    parts = text.lower().split()  # bytes: lower-cases A-Z and splits at ASCII white space only
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(parts) > words:
        starts, ends = starts[: len(parts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    found = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist())]
    return np.array(found, np.uint64)


def fingerprint(text: bytes) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text."""
    h = shingle_hashes(text)
    if not len(h):
        return 0
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 65_536):
        counts += np.unpackbits(h[k : k + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", row: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), and the row itself as a struct if asked; map-only."""
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__vx_row")] if row else []
    bounded_batches(docs)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__vx_text"), *whole)
    schema = T.StructType([own.schema["doc_id"], T.StructField("fp", T.LongType()), *own.schema.fields[2:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), *batch.columns[2:]], names=schema.names)

    return own.mapInArrow(run, schema)


def pivots(n: int = PIVOTS, seed: int = PIVOT_SEED) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, np.uint64, endpoint=False)


def pivot_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distance of each fingerprint to each reference, as bytes."""
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)


def scheme(distinct: int, threshold: int = THRESHOLD) -> tuple[int, int]:
    """The first scheme whose groups of unrelated fingerprints stay small; all of them lose no link."""
    for blocks, agree in SCHEMES:
        if distinct >> (BITS * agree // blocks) < 8:
            break
    return agree + threshold, agree


def block_masks(blocks: int, agree: int) -> list[int]:
    """Bit masks of every choice of ``agree`` blocks."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    single = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(blocks)]
    return [sum(c) for c in combinations(single, agree)]


def near(a: np.ndarray, table_a: np.ndarray, b: np.ndarray, table_b: np.ndarray, threshold: int, tally: np.ndarray) -> np.ndarray:
    """Of pairs given side by side (or one against many): which link. ``tally`` counts pairs, survivors of the rows, links."""
    alive = np.flatnonzero(np.abs(table_a - table_b).max(axis=1, initial=0) <= threshold)
    hit = alive[np.bitwise_count((a if a.ndim == 0 else a[alive]) ^ b[alive]) <= threshold]
    tally += (len(b), len(alive), len(hit))
    return hit


def spanning_edges(fps: np.ndarray, table: np.ndarray, threshold: int, tally: np.ndarray) -> list[tuple[int, int]]:
    """Edges (positions) that connect exactly what links of this group connect."""
    left, edges = np.arange(len(fps)), []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            at = front.pop()
            hit = near(fps[at], table[at], fps[left], table[left], threshold, tally)
            if len(hit):
                found = left[hit]
                edges += [(at, int(x)) for x in found]
                front += found.tolist()
                left = np.delete(left, hit)
    return edges


def _group_edges(keys: np.ndarray, fps: np.ndarray, table: np.ndarray, threshold: int, tally: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges inside the runs of equal keys (sorted). Short runs are compared all at once, shifted by 1, 2, ..."""
    ends = np.flatnonzero(np.append(keys[1:] != keys[:-1], True)) + 1
    starts = np.concatenate([[0], ends[:-1]])
    sizes, a, b = ends - starts, [], []
    for s, e in zip(starts[sizes > 32], ends[sizes > 32]):
        for x, y in spanning_edges(fps[s:e], table[s:e], threshold, tally):
            a.append(fps[s + x])
            b.append(fps[s + y])
    at = np.flatnonzero(np.repeat((sizes <= 32) & (sizes > 1), sizes))
    out_a, out_b = [np.array(a, np.uint64)], [np.array(b, np.uint64)]
    run_end = np.repeat(ends, sizes)
    for shift in range(1, 32):
        at = at[at + shift < run_end[at]]
        if not len(at):
            break
        hit = near(fps[at], table[at], fps[at + shift], table[at + shift], threshold, tally)
        out_a.append(fps[at[hit]])
        out_b.append(fps[at[hit] + shift])
    return np.concatenate(out_a), np.concatenate(out_b)


#: What a row of ``met`` holds: an edge, a member of a large group, or (per task) pairs, survivors and links in u, v, n.
EDGE, LARGE, TALLY = 0, 1, 2


def met(distinct: DataFrame, threshold: int = THRESHOLD, group_rows: int = GROUP_ROWS) -> DataFrame:
    """kind, u, v, n: what the groups of fingerprints (column fp) give, materialised."""
    masks = np.array(block_masks(*scheme(distinct.count(), threshold)), np.uint64)
    refs = pivots()

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each fingerprint's table row is made here, once, and copied into its groups."""
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(refs)), len(fps), [None, pa.py_buffer(pivot_table(fps, refs).tobytes())]).cast(pa.binary())
            for k, mask in enumerate(masks):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), k, np.int32)), pa.array((fps & mask).view(np.int64)), pa.array(fps.view(np.int64)), rows], names=["mask", "part", "fp", "pivots"])

    def out(kind: int, u: np.ndarray, v: np.ndarray, n: int = 0) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, np.int32)), pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), pa.array(np.full(len(u), n, np.int64))], names=["kind", "u", "v", "n"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(upto: int) -> Iterator[pa.RecordBatch]:
            if upto:
                k = held[0][:upto]
                run = np.concatenate([[0], np.cumsum((k[1:] != k[:-1]).any(axis=1))])
                yield out(EDGE, *_group_edges(run, held[1][:upto], held[2][:upto], threshold, tally))

        tally, passing = np.zeros(3, np.int64), None
        held = [np.empty((0, 2), np.int64), np.empty(0, np.uint64), np.empty((0, len(refs)), np.int8)]
        for batch in batches:
            k = np.stack([batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy(zero_copy_only=False)], axis=1)
            f = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            t = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int8).reshape(-1, len(refs))
            if passing is not None:  # the rest of a large group
                same = (k == passing).all(axis=1)
                yield out(LARGE, f[same], f[same])
                k, f, t, passing = k[~same], f[~same], t[~same], passing if same.all() else None
            held = [np.concatenate([x, y]) for x, y in zip(held, (k, f, t))]
            if not len(held[1]):
                continue
            last = int(np.argmax((held[0] == held[0][-1]).all(axis=1)))  # the last group may go on in the next batch
            yield from done(last)
            held = [x[last:] for x in held]
            if len(held[1]) > group_rows:
                passing = held[0][-1]
                yield out(LARGE, held[1], held[1])
                held = [x[:0] for x in held]
        yield from done(len(held[1]))
        yield out(TALLY, tally[:1], tally[1:2], int(tally[2]))

    keyed = distinct.select("fp").mapInArrow(expand, "mask int, part long, fp long, pivots binary")
    found = keyed.repartition("mask", "part").sortWithinPartitions("mask", "part").mapInArrow(compare, "kind int, u long, v long, n long")
    return materialise(found, "simhash-met", narrow=True)


def figures(found: DataFrame) -> dict[str, int]:
    """Pairs that met in ``met``, those that the pivot rows let through, and those that linked."""
    row = found.where(F.col("kind") == TALLY).agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("u", "v", "n")]).first()
    return dict(zip(("pairs", "survivors", "links"), row))


def links(found: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """u, v: edges between fingerprints whose components are those of all links. ``found``: of ``met``."""
    small = found.where(F.col("kind") == EDGE).select("u", "v")
    large = found.where(F.col("kind") == LARGE)
    if large.limit(1).count() == 0:
        return small
    return small.union(_within_half(large.select(F.col("u").alias("fp")).distinct(), threshold))


def _within_half(fps: DataFrame, threshold: int) -> DataFrame:
    """Edges of a large group: two values are within 2r bits exactly if some value lies within r of both."""
    if threshold % 2:
        raise ValueError("the way for large groups needs an even threshold")
    masks = np.array([sum(1 << b for b in c) for r in range(threshold // 2 + 1) for c in combinations(range(BITS), r)], np.uint64)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp in batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64):
                yield pa.RecordBatch.from_arrays([pa.array((fp ^ masks).view(np.int64)), pa.array(np.full(len(masks), fp).view(np.int64))], names=["near", "fp"])

    spread = fps.repartition(F.col("fp")).mapInArrow(expand, "near long, fp long")
    least = spread.groupBy("near").agg(F.min("fp").alias("u"), F.max("fp").alias("v"), F.count(F.lit(1)).alias("n"))
    stars = materialise(least.where("n > 1").select("near", "u", "n"), "simhash-near")
    return spread.join(stars, "near").select("u", F.col("fp").alias("v")).where("u <> v").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """node, root: every node that has an edge, with the smallest node it can reach.

    Alternates large-star and small-star steps, each with map-side minima, until nothing changes;
    every round is written to the shared folder, so a lost executor costs one round at most.
    """
    edges = materialise(edges.where("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct(), "cc-0", narrow=True)
    state, turn = None, 0
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state, turn = now, turn + 1
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
        small = large.join(least, F.col("u") == F.col("c")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        before, edges = edges, materialise(small, f"cc-{turn}", narrow=True)
        discard(before)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(docs: DataFrame, text: str = "text", threshold: int = THRESHOLD, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, fp, root (a fingerprint that names the component) and component_id: one row per document row."""
    own = materialise(fingerprints(docs, text), "simhash-fps", narrow=True)
    distinct = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct", narrow=True)
    roots = connected(links(met(distinct, threshold, group_rows), threshold))
    of = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = of.groupBy("root").agg(F.min("least").alias("component_id"))
    found = of.join(named, "root").select(F.col("fp").alias("__vx_fp"), "root", "component_id")
    return own.join(found, F.col("fp") == F.col("__vx_fp")).select("doc_id", "fp", "root", "component_id")


def near_duplicate_components(docs: DataFrame, text: str = "text", threshold: int = THRESHOLD, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per document row."""
    return classes(docs, text, threshold, group_rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The documents with their own columns, one row of each component: one with the smallest id, nulls last.

    Where ids are not unique, rows are told apart by id and fingerprint, so that rows which share an
    id (or have none) but belong to different components all stay.
    """
    found = materialise(classes(docs, text, threshold), "simhash-classes", narrow=True)
    if found.groupBy("doc_id").count().where("count > 1").limit(1).count() == 0:
        lost = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__vx_id"))
        side = F.broadcast(lost) if lost.limit(BROADCAST_LOST + 1).count() <= BROADCAST_LOST else lost.hint("shuffle_hash")  # hashed: texts stream past it
        return docs.join(side, docs["doc_id"].eqNullSafe(F.col("__vx_id")), "left_anti")
    first = found.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "fp")).alias("m")).select(F.col("m.doc_id").alias("__vx_id"), F.col("m.fp").alias("__vx_fp"))
    rows = fingerprints(docs, text, row=True)
    kept = rows.join(first, rows["doc_id"].eqNullSafe(first["__vx_id"]) & (rows["fp"] == first["__vx_fp"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "fp"]).select("__vx_row.*")
