"""Mixing sources to target weights by hierarchical budgets and seeded epochs.

The tree is domain, language, source. A node's tokens are split among its children by weight, none
getting more than it can supply (tokens below it times ``max_epochs``). What one child cannot supply
goes to its siblings first; only what the whole subtree cannot supply reaches the siblings of an
ancestor, since the subtree's own supply caps it there.

A leaf's budget is some whole epochs and a prefix of one more. Each epoch orders the leaf's
documents by a seeded hash; the prefix takes documents while their tokens fit. Prefixes are found
in rounds: each sums the tokens of 64 hash ranges per leaf and goes on inside the one range that
holds the end, until that range holds few rows. So a task sees at most 64 sums, or ``RANGE_ROWS``
rows, of a leaf, however large the leaf.

Edge cases: a null lang or source is its own leaf. Null and empty texts have one token (their end).
Rows that share a doc_id, or have none, share their hash, are summed before they meet, and are taken
together or not at all. A child without
weight gets nothing. An empty table gives no rows. Clashing column names pass through untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_checked, materialise
from .token_counts import token_lengths

LEVELS = ("__vx_domain", "__vx_lang", "__vx_source")
#: Bits of the hash that a round looks at, rows of a leaf's open range that end the rounds, and bits of the hash.
ROUND_BITS, RANGE_ROWS, HASH_BITS = 6, 500, 63
SEED = 17
DOMAINS = ("web", "reference", "forum", "code")
DOMAIN_WEIGHTS = {"web": 0.4, "reference": 0.3, "forum": 0.2, "code": 0.1}
LANG_WEIGHTS = {"en": 0.55, "de": 0.15, "es": 0.15, "fr": 0.15}


def domain_of_source() -> Column:
    """The tables name no domains: the number that ends a source's name deals sources to domains in turn."""
    number = F.coalesce(F.regexp_extract(F.col("source"), r"(\d+)$", 1).try_cast("long"), F.lit(0))
    return F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), (F.pmod(number, F.lit(len(DOMAINS))) + 1).cast("int"))


def weight_of(weights: dict[str, float], level: str, other: float = 1.0) -> Column:
    out = F.lit(other)
    for name, w in weights.items():
        out = F.when(F.col(level) == name, F.lit(float(w))).otherwise(out)
    return out


def default_weights(level: str) -> Column:
    if level == LEVELS[0]:
        return weight_of(DOMAIN_WEIGHTS, level, 0.0)
    return weight_of(LANG_WEIGHTS, level, 0.05) if level == LEVELS[1] else F.lit(1.0)


def keys(domain: Column | None = None) -> list[Column]:
    return [(domain if domain is not None else domain_of_source()).alias(LEVELS[0]), F.coalesce(F.col("lang"), F.lit("")).alias(LEVELS[1]), F.coalesce(F.col("source"), F.lit("")).alias(LEVELS[2])]


def water_fill(children: DataFrame, parents: list[str]) -> DataFrame:
    """Adds ``share``: ``budget`` (of the parent) split by ``weight`` under ``cap``.

    In order of cap/weight, a child is full if what is left for it and all later ones, spread by
    weight, reaches its cap; the others share what the full ones leave.
    """
    own = [F.lit(0)] if not parents else [F.col(p) for p in parents]
    group = Window.partitionBy(*own)
    order = group.orderBy(F.col("cap") / F.col("weight"), *LEVELS[: len(parents) + 1])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    fed = children.where((F.col("weight") > 0) & (F.col("cap") > 0))
    fed = fed.withColumn("left_b", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("left_w", F.sum("weight").over(group) - F.coalesce(F.sum("weight").over(before), zero))
    fed = fed.withColumn("full", F.col("left_b") * F.col("weight") >= F.col("cap") * F.col("left_w"))
    rest = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(group), F.lit(0))
    loose = F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(zero)).over(group)
    share = F.when(F.col("full"), F.col("cap")).otherwise(F.floor(rest * F.col("weight") / loose))
    return fed.withColumn("share", F.greatest(F.lit(0), share).cast("long")).drop("left_b", "left_w", "full")


def leaf_budgets(leaves: DataFrame, budget: int, max_epochs: int, weights: Callable[[str], Column] = default_weights) -> DataFrame:
    """The level columns, tokens and share of each leaf with a budget. ``leaves``: levels, tokens."""
    tree = leaves.withColumn("supply", F.col("tokens") * F.lit(max_epochs))
    for level in LEVELS:  # a node supplies only what its descendants with weight do
        tree = tree.where(weights(level) > 0)
    above = None
    for k, level in enumerate(LEVELS):
        at = list(LEVELS[: k + 1])
        nodes = tree.groupBy(*at).agg(F.sum("supply").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("weight", weights(level))
        nodes = nodes.withColumn("budget", F.lit(int(budget))) if above is None else nodes.join(above, at[:-1])
        above = water_fill(nodes, at[:-1]).select(*at, "tokens", "share")
        if k < len(LEVELS) - 1:
            above = above.select(*at, F.col("share").alias("budget"))
    return above


def hash63(seed: int, epoch: Column) -> Column:
    """The order of an epoch: non-negative, so that ranges of it are ranges of its leading bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch.cast("long"), F.col("doc_id")), 1)


def plan(measured: DataFrame, budget_share: float, max_epochs: int, seed: int = SEED, weights: Callable[[str], Column] = default_weights) -> DataFrame:
    """Levels, whole (epochs taken whole) and upto (largest hash of the epoch after them, -1: none).

    ``measured``: doc_id, levels, n_tokens.
    """
    leaves = materialise(measured.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    shares = leaf_budgets(leaves, int(total * budget_share), max_epochs, weights)
    shares = materialise(shares.withColumn("whole", F.floor(F.col("share") / F.col("tokens"))).withColumn("rest", F.pmod(F.col("share"), F.col("tokens"))), "mix-shares")
    levels = list(LEVELS)
    rest = shares.where("rest > 0").select(*levels, "whole", "rest")
    hashed = join_checked(measured, rest, levels).select(*levels, hash63(seed, F.col("whole")).alias("h"), "n_tokens")
    ends = rest.select(*levels, "rest", F.lit(0).cast("long").alias("range"), F.lit(0).cast("long").alias("base"))
    bits, rows = 0, RANGE_ROWS + 1
    while rows > RANGE_ROWS and bits < HASH_BITS - ROUND_BITS:
        ends, bits = materialise(_narrowed(hashed, ends, bits), "mix-ends"), bits + ROUND_BITS
        rows = ends.agg(F.coalesce(F.max("rows"), F.lit(0))).first()[0]
        ends = ends.drop("rows")
    inside = _open(hashed, ends, bits).groupBy(*levels, "rest", "base", "h").agg(F.sum("n_tokens").alias("t"))
    running = Window.partitionBy(*levels).orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    last = inside.withColumn("upto", F.col("base") + F.sum("t").over(running)).where(F.col("upto") <= F.col("rest")).groupBy(*levels).agg(F.max("h").alias("last"))
    out = shares.select(*levels, "whole").join(ends.select(*levels, "range"), levels, "left").join(last, levels, "left")
    upto = F.coalesce("last", F.shiftleft(F.col("range"), HASH_BITS - bits) - 1, F.lit(-1))
    return materialise(out.select(*levels, "whole", upto.alias("upto")), "mix-plan")


def _open(hashed: DataFrame, ends: DataFrame, bits: int) -> DataFrame:
    """The rows in their leaf's open range, with the columns of ``ends``; ``range`` is that range's leading ``bits`` of the hash."""
    if not bits:
        return join_checked(hashed, ends, list(LEVELS))
    return join_checked(hashed.withColumn("range", F.shiftright("h", HASH_BITS - bits)), ends, [*LEVELS, "range"])


def _narrowed(hashed: DataFrame, ends: DataFrame, bits: int) -> DataFrame:
    """The range, ``ROUND_BITS`` finer, that holds each leaf's end, the tokens before it (``base``) and its rows."""
    levels = list(LEVELS)
    fine = _open(hashed, ends, bits).withColumn("range", F.shiftright("h", HASH_BITS - bits - ROUND_BITS))
    sums = fine.groupBy(*levels, "rest", "base", "range").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("rows"))
    order = Window.partitionBy(*levels).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    past = sums.withColumn("upto", F.col("base") + F.sum("t").over(order)).where(F.col("upto") > F.col("rest"))
    first = past.groupBy(*levels, "rest").agg(F.min(F.struct("range", (F.col("upto") - F.col("t")).alias("base"), "rows")).alias("end"))
    return first.select(*levels, "rest", "end.range", "end.base", "end.rows")


def copies(docs: DataFrame, planned: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds epochs (long): how often each document is taken. ``docs`` has doc_id and the levels."""
    out = join_checked(docs, planned, list(LEVELS), "left")
    taken = F.col("whole") + (hash63(seed, F.col("whole")) <= F.col("upto")).cast("long")
    return out.withColumn("epochs", F.coalesce(taken, F.lit(0))).drop("whole", "upto")


def mixture(docs: DataFrame, budget_share: float = 0.8, max_epochs: int = 4, seed: int = SEED, domain: Column | None = None, weights: Callable[[str], Column] = default_weights) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, epochs: one row per document row, untaken ones too."""
    measured = materialise(token_lengths(docs, F.col("doc_id"), *keys(domain), end_ids=1), "mix-tokens", narrow=True)
    out = copies(measured, plan(measured, budget_share, max_epochs, seed, weights), seed)
    return out.select("doc_id", *[F.col(k).alias(k[5:]) for k in LEVELS], "n_tokens", "epochs")


def mix(docs: DataFrame, budget_share: float = 0.8, max_epochs: int = 4, seed: int = SEED, domain: Column | None = None, weights: Callable[[str], Column] = default_weights) -> DataFrame:
    """The documents with their own columns, each as often as it is taken. Texts are not shuffled."""
    measured = materialise(token_lengths(docs, F.col("doc_id"), *keys(domain), end_ids=1), "mix-tokens", narrow=True)
    planned = plan(measured, budget_share, max_epochs, seed, weights)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__vx_row")
    taken = copies(docs.select(row, F.col("doc_id"), *keys(domain)), planned, seed).where("epochs > 0")
    if max_epochs > 1:
        taken = taken.select("__vx_row", F.explode(F.sequence(F.lit(1), F.col("epochs"))))
    return taken.select("__vx_row.*")
