"""Splitting the table's byte ranges into even, aligned groups of work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def split_runs(runs: list[tuple[int, int]], groups: int, align: int) -> list[list[tuple[int, int]]]:
    """In-order split into ``groups`` equal shares of whole ``align`` bytes; the last takes the remainder."""
    total = sum(b - a for a, b in runs)
    if groups < 1 or total % align:
        raise ValueError("need at least one group, and runs of whole units")
    share = total // align // groups * align
    out: list[list[tuple[int, int]]] = [[] for _ in range(groups)]
    at = 0
    for a, b in runs:
        while a < b:
            k = min(at // share, groups - 1) if share else groups - 1
            room = b - a if k == groups - 1 else min(b - a, (k + 1) * share - at)
            out[k].append((a, a + room))
            a, at = a + room, at + room
    return out


def split_runs_frame(runs: DataFrame, keys: list[str], order: str, groups: int) -> DataFrame:
    """The relational form: runs (``clusters`` each) per key, cut at group borders.

    Adds group, from_cluster and n_clusters (within the run). Groups are found by prefix sums.
    """
    own = Window.partitionBy(*keys)
    before = own.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = runs.withColumn("__at", F.coalesce(F.sum("clusters").over(before), F.lit(0))).withColumn("__share", F.floor(F.sum("clusters").over(own) / groups)).where("clusters > 0")
    last = F.lit(groups - 1)
    of = lambda at: F.when(F.col("__share") > 0, F.least(F.floor(at / F.col("__share")), last)).otherwise(last)
    df = df.withColumn("group", F.explode(F.sequence(of(F.col("__at")), of(F.col("__at") + F.col("clusters") - 1))))
    start = F.greatest(F.col("__at"), F.col("group") * F.col("__share"))
    start = F.when(F.col("__share") > 0, start).otherwise(F.col("__at"))
    end = F.when(F.col("group") == last, F.col("__at") + F.col("clusters")).otherwise(F.least(F.col("__at") + F.col("clusters"), (F.col("group") + 1) * F.col("__share")))
    return df.withColumn("from_cluster", start - F.col("__at")).withColumn("n_clusters", end - start).drop("__at", "__share")
