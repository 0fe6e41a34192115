"""Quality rules whose cutoffs come with a guarantee on how many good documents they reject.

The rules' cutoffs form one ladder: level 1 holds every rule at its loosest cutoff, and each further
level moves every rule to its next tighter one. A document's level is the first at which some rule
rejects it, so a labelled holdout is small counts by stratum and level. In each stratum the levels
are tested from the loosest on, all rules together: a level is valid when an exact binomial test,
P(Bin(n, limit) <= rejected good documents) <= d, refutes a false rejection rate above ``limit``, and
testing ends at the first failure (fixed sequence, no further correction); over strata ``error`` is
divided by their number (Bonferroni) to give d. So with confidence 1 - ``error`` the rules falsely
reject at most ``limit`` in every stratum at once. Of the valid levels the one with the largest
excess of rejected bad documents over ``WORTH`` times the good ones is used, ties going to the looser
one; a stratum with no such level (too few labels: 217 good documents for four strata) rejects nothing beyond the base rules.

Edge cases: a null or empty text has no words and fails the base rules. A null stratum counts as the
empty string. Labels without a document, without quality or with a null id are ignored; a document
labelled both ways counts as bad. Repeated document rows are judged each, but are one document of
the holdout, at the lowest of their levels and the first of their strata. Empty tables give no levels
and no rows. Other columns of either table are never read.
"""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, discard, join_checked, materialise

#: Rules: name and ascending cutoffs; a document is rejected when its feature is above the cutoff. Level k is the k-th from the end.
RULES: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0),
    "repeat_share": (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5),
    "dup_line_share": (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.8),
    "upper_share": (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "marks_per_word": (0.1, 0.2, 0.3, 0.4, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0),
    "word_length": (6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0),
}
LEVELS = max(map(len, RULES.values()))
NEVER = LEVELS + 1
MIN_WORDS = 50
LIMIT, ERROR = 0.02, 0.05
#: Bad documents that must go for each good one that a tighter level loses within the limit.
WORTH = 3

_SPACE = b" \t\n\r\x0b\x0c"
_NOT_WORD = _SPACE + bytes(range(0x80, 0xC0))  # white space, and bytes that continue a code point
_SYMBOLS = b"#*$%&|<>"
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))

BASE = (("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"))
FEATURES = [T.StructField(n, T.LongType()) for n, _ in BASE] + [T.StructField(n, T.DoubleType()) for n in RULES]


def count_of(text: bytes, these: bytes) -> int:
    return len(text) - len(text.translate(None, these))


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more, first occurrences included."""
    windows = list(zip(words, words[1:], words[2:]))
    once: set = set()
    twice: set = set()
    for w in windows:
        if w in once:
            twice.add(w)
        else:
            once.add(w)
    if not twice:
        return 0
    covered, upto = 0, 0
    for k, w in enumerate(windows):
        if w in twice:
            covered += k + 3 - max(k, upto)
            upto = k + 3
    return covered


def measure(text: bytes) -> tuple:
    """The base counts and the rules' features of one text, given as UTF-8."""
    words = text.split()
    n = len(words)
    seen: set = set()
    lines = dups = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dups += 1
            else:
                seen.add(line)
    chars, symbols, repeats = len(text.translate(None, _NOT_WORD)), count_of(text, _SYMBOLS), repeat_words(words)
    upper, lower = count_of(text, _UPPER), count_of(text, _LOWER)
    return (
        n, chars, symbols, dups, repeats,
        symbols / max(n, 1), repeats / max(n, 1), dups / max(lines, 1), upper / max(upper + lower, 1), count_of(text, _MARKS) / max(n, 1), chars / max(n, 1),
    )


FEATURE_TYPE = T.StructType(FEATURES)


@F.arrow_udf(FEATURE_TYPE)
def _measured(texts: pa.Array) -> pa.Array:
    columns = list(zip(*[measure(x.as_py() or b"") for x in texts.cast(pa.large_binary())])) or [()] * len(FEATURES)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64() if k < len(BASE) else pa.float64()) for k, c in enumerate(columns)], [f.name for f in FEATURES])


def features(text: str = "text") -> Column:
    """The base counts and features of whole texts as one struct; texts go to Python, only counts come back."""
    return _measured(F.col(text).cast("binary"))


def base_failed(m: str = "__vx_m") -> Column:
    return (F.col(f"{m}.n_words") < MIN_WORDS) | (100 * F.col(f"{m}.n_repeat_words") > 50 * F.col(f"{m}.n_words"))


def level(m: str = "__vx_m") -> Column:
    """The first level at which some rule rejects; ``NEVER`` if none does."""
    first = []
    for rule, cs in RULES.items():
        above = sum((F.col(f"{m}.{rule}") > F.lit(c)).cast("int") for c in cs)
        first.append(F.when(above > 0, len(cs) + 1 - above).otherwise(NEVER))
    return F.least(*first)


def cutoffs_at(k: int) -> dict[str, float]:
    """The cutoffs of a level; a rule that has run out of tighter ones stays at its tightest."""
    return {rule: cs[max(0, len(cs) - k)] for rule, cs in RULES.items()}


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly up to rounding."""
    if k >= n:
        return 1.0
    lp, lq, top = math.log(p), math.log1p(-p), math.lgamma(n + 1)
    terms = [top - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * lp + (n - i) * lq for i in range(k + 1)]
    most = max(terms)
    return min(1.0, math.exp(most) * math.fsum(math.exp(t - most) for t in terms))


def least_good(rate: float, error: float) -> int:
    """Good documents below which not even a cutoff that rejects none of them can be valid."""
    return math.ceil(math.log(error) / math.log1p(-rate))


def pick_level(good: list[int], bad: list[int], limit: float, error: float) -> int:
    """``good[k]``, ``bad[k]``: labelled documents of level k (the last: never rejected). 0: no level."""
    n, best, chosen, lost, caught = sum(good), 0, 0, 0, 0
    for k in range(1, LEVELS + 1):  # loosest first
        lost, caught = lost + good[k], caught + bad[k]
        # P(Bin <= lost) is over 0.4 once lost reaches the mean, so the sum stays short
        if n == 0 or lost >= n * limit + 1 or binomial_tail(lost, n, limit) > error:
            break
        if caught - WORTH * lost > best:
            best, chosen = caught - WORTH * lost, k
    return chosen


def levels(measured: DataFrame, labels: DataFrame, limit: float = LIMIT, error: float = ERROR) -> DataFrame:
    """``__vx_stratum`` and ``__vx_chosen``: one row per stratum that has a valid level.

    ``measured``: ``__vx_id``, ``__vx_stratum``, ``__vx_level``, ``__vx_failed``; ``labels``: doc_id,
    quality. Only small rows move: the texts have been reduced to levels before.
    """
    marked = (
        labels.select(F.col("doc_id").alias("__vx_id"), F.col("quality").alias("__vx_quality"))
        .where("__vx_id is not null and __vx_quality is not null")
        .groupBy("__vx_id").agg(F.min("__vx_quality").alias("__vx_quality"))
    )
    documents = measured.where("not __vx_failed and __vx_id is not null").groupBy("__vx_id").agg(F.min("__vx_stratum").alias("__vx_stratum"), F.min("__vx_level").alias("__vx_level"))
    counts = (
        documents.join(marked, "__vx_id").groupBy("__vx_stratum", "__vx_level")
        .agg(F.sum((F.col("__vx_quality") > 0).cast("long")).alias("good"), F.sum((F.col("__vx_quality") <= 0).cast("long")).alias("bad"))
    )
    counts = materialise(counts, "rule-counts")
    strata = max(1, counts.where("good > 0").select("__vx_stratum").distinct().count())

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        good, bad = [0] * (NEVER + 1), [0] * (NEVER + 1)
        for k, g, w in pdf[["__vx_level", "good", "bad"]].itertuples(index=False):
            good[k], bad[k] = int(g), int(w)
        return pd.DataFrame([{"__vx_stratum": pdf["__vx_stratum"].iloc[0], "__vx_chosen": pick_level(good, bad, limit, error / strata)}])

    chosen = counts.groupBy("__vx_stratum").applyInPandas(choose, "__vx_stratum string, __vx_chosen int").where("__vx_chosen > 0")
    chosen = materialise(chosen, "rule-levels")
    discard(counts)
    return chosen


def stratum(column: str = "lang") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def measured(docs: DataFrame, keep: list[Column], strata: str = "lang") -> DataFrame:
    """``keep`` columns, the features as a struct and what follows from them, written once."""
    bounded_batches(docs)
    own = docs.select(*keep, F.col("doc_id").alias("__vx_id"), stratum(strata).alias("__vx_stratum"), features().alias("__vx_m"))
    return materialise(own.withColumn("__vx_failed", base_failed()).withColumn("__vx_level", level()), "rule-features")


def judge(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Adds __vx_kept."""
    out = join_checked(rows, chosen, "__vx_stratum", "left")
    return out.withColumn("__vx_kept", ~F.col("__vx_failed") & (F.col("__vx_level") > F.coalesce("__vx_chosen", F.lit(0))))


def quality_verdicts(docs: DataFrame, labels: DataFrame, strata: str = "lang", limit: float = LIMIT, error: float = ERROR) -> DataFrame:
    """doc_id, the base counts, the features, base_failed and kept, one row per document row."""
    rows = measured(docs, [], strata)
    return judge(rows, levels(rows, labels, limit, error)).select(F.col("__vx_id").alias("doc_id"), "__vx_m.*", F.col("__vx_failed").alias("base_failed"), F.col("__vx_kept").alias("kept"))


def quality_filter(docs: DataFrame, labels: DataFrame, strata: str = "lang", limit: float = LIMIT, error: float = ERROR) -> DataFrame:
    """The documents that stay, with their own columns.

    Rows are written once with their features, so that each text is measured once and none is shuffled.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = measured(docs, own, strata)
    return judge(rows, levels(rows, labels, limit, error)).where("__vx_kept").select(*own)
