"""Secret scans in DataFrame operations only.

Base kinds are patterns (assignments, access keys, hex runs). The method adds candidate strings of a
character class whose Shannon entropy, over some window of ``WINDOW`` characters, reaches the class's
threshold. The window slides: one count goes up and one down per step, and the sum of c log2 c with
it, so a candidate costs its length times the window and no window is counted anew within a block. Candidates that
an allow-list matches (UUIDs, paths, placeholders, plain words) add nothing; base spans always stay.
The narrow classes have the lower thresholds of smaller alphabets and report only what lies in no span
of another kind, so a string is not reported once per alphabet.

Positions are code points. They are running sums of the lengths of the parts between matches (the
text split by the same pattern), so no text is scanned per match; running sums double their reach
at each step, so a text with n matches costs n log n.

Edge cases: a null or empty text has no spans. Repeated rows are scanned each. Other columns are
never read. A span found by entropy that lies inside a base span is not reported again. A candidate
or a text of any length costs time in proportion (n log n in its matches): no pattern recurses, and
a candidate is not read on once a window has reached the threshold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 20
#: Windows of a candidate that are tried together.
BLOCK = 500
SPACE_RUN = "\\x20*"
#: Kinds in their order: pattern, group that is measured, least length of it.
BASE: dict[str, tuple[str, int, int]] = {
    "assign": ("(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": ("AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": ("[0-9a-f]{24,}", 0, 24),
}
#: Classes of candidates: pattern, least entropy in bits over a window. A class needs letters and digits both.
CLASSES: dict[str, tuple[str, float]] = {
    "entropy_base64": ("[A-Za-z0-9+/_-]{20,}={0,2}", 3.9),
    "entropy_hex": ("(?i)(?<![0-9a-z])[0-9a-f]{20,}(?![0-9a-z])", 2.9),
}
#: Classes of smaller alphabets, or of strings known to use both cases, in the same form. Like entropy_hex, each threshold is
#: about the 1 % quantile of one window of random characters: 16, 36, 32 (base32, the smaller of the upper-case ones) and 62 symbols.
NARROW: dict[str, tuple[str, float]] = {
    "entropy_lower": ("(?<![A-Za-z0-9])[a-z0-9]{20,}(?![A-Za-z0-9])", 3.4),
    "entropy_upper": ("(?<![A-Za-z0-9])[A-Z0-9]{20,}(?![A-Za-z0-9])", 3.33),
    "entropy_mixed": ("(?<![A-Za-z0-9+/_-])" + "".join(f"(?=[A-Za-z0-9+/_-]*[{x}])" for x in ("a-z", "A-Z", "0-9")) + "[A-Za-z0-9+/_-]{20,}={0,2}", 3.62),
}
#: Kinds by rank; a span is hidden by one of a lower rank that holds it, but the two of ``CLASSES`` do not hide each other.
KINDS = (*BASE, *CLASSES, *NARROW)
BARS = tuple(len(BASE) if k in CLASSES else rank for rank, k in enumerate(KINDS))
#: Paths of words. Their repeats are possessive, which loses nothing (each part ends at its separator) and does not recurse.
PATH = "^(?:/?[a-z]+[0-9]{0,4}[/_-])++[a-z]*[0-9]{0,4}$"
#: Paths of words in both cases; of mixed candidates only, whose threshold such words often reach.
MIXED_PATH = "(?i)" + PATH
_PLACEHOLDER = "(?:example|placeholder|changeme|xxxx|0123456789|abcdefgh)"
#: Candidates that are never secrets: no digit or no letter, UUIDs, placeholders (up to three, with less than a window
#: before, between and after them, so that no key stands beside), the public AWS example, paths of words, one repeated unit.
ALLOWED = (
    "^[^0-9]*$", "^[^A-Za-z]*$",
    "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    f"(?i)^.{{0,19}}{_PLACEHOLDER}(?:.{{0,19}}{_PLACEHOLDER}){{0,2}}.{{0,19}}$",
    "^wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY$",
    PATH,
    "^(.{1,8})\\1+$",
)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` over ``value``, which is evaluated once, also for uses inside lambdas (a one-element array binds it)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running ``op`` (associative) over a bound array, each element included: every step takes in the result 1, 2, 4, ... before."""
    steps = F.transform(F.filter(F.sequence(F.lit(0), F.lit(30)), lambda j: F.pow(F.lit(2), j) < F.size(values)), lambda j: F.pow(F.lit(2), j).cast("int"))
    return F.aggregate(steps, values, lambda acc, d: F.transform(acc, lambda x, i: F.when(i >= d, op(F.get(acc, i - d), x)).otherwise(x)))


def matches(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Array of struct(start, end, value) of the leftmost non-overlapping matches, in order."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    found = F.struct(whole.alias("whole"), F.transform(part, lambda p: F.char_length(p) >= least).alias("long_enough"), gaps.alias("gaps"))

    def spans(b: Column) -> Column:
        """A match starts after the gap before it, which starts where the match before ends."""
        moves = F.transform(b["whole"], lambda w, i: F.get(b["gaps"], i) + F.when(i > 0, F.char_length(F.get(b["whole"], i - 1))).otherwise(0))
        return bound(bound(moves, lambda m: running(m, lambda x, y: x + y)), lambda starts: F.transform(b["whole"], lambda w, i: F.struct(F.get(starts, i).alias("start"), (F.get(starts, i) + F.char_length(w)).alias("end"), w.alias("value"), F.get(b["long_enough"], i).alias("long_enough"))))

    empty = F.array().cast("array<struct<start:int,end:int,value:string,long_enough:boolean>>")
    return F.when(text.rlike(pattern), F.filter(bound(found, spans), lambda s: s["long_enough"])).otherwise(empty)


def peak_entropy(value: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy (bits) over the windows of an ASCII string, bound as bytes, whose places need no scan; one window if it is shorter."""
    term = lambda c: F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))
    count = lambda part, c: F.octet_length(part) - F.octet_length(F.replace(part, c, F.lit("")))
    at = lambda k, n: F.substring(value, k + 1, n).cast("string")

    def step(acc: Column, k: Column) -> Column:
        """Among the characters that stay, one seen c times adds term(c + 1) - term(c) when it enters and takes that when it leaves."""
        stay = at(F.greatest(k - window + 1, F.lit(0)), F.least(k, F.lit(window - 1)))
        come, go = count(stay, at(k, F.lit(1))), count(stay, at(k - window, F.lit(1)))
        total = acc["sum"] + term(come + 1) - term(come) - F.when(k >= window, term(go + 1) - term(go)).otherwise(F.lit(0.0))
        n = F.least(k + 1, F.lit(window))
        most = lambda t: F.when(k + 1 >= F.least(F.octet_length(value), F.lit(window)), F.greatest(acc["most"], F.log2(n) - t / n)).otherwise(acc["most"])
        return bound(total, lambda t: F.struct(t.alias("sum"), most(t).alias("most")))

    return F.aggregate(F.sequence(F.lit(0), F.octet_length(value) - 1), F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("most")), step, lambda a: a["most"])


def reaches(value: Column, least: float, window: int = WINDOW) -> Column:
    """Whether a window of the string reaches the entropy; read block by block up to the first that does, without blocks of too few characters."""

    def hot(block: Column) -> Column:
        rich = F.size(F.array_distinct(F.split(block.cast("string"), ""))) >= 2**least
        return rich & (peak_entropy(block, window) >= least)

    def over(b: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.octet_length(b) - window, F.lit(0)), F.lit(BLOCK))
        return F.exists(starts, lambda at: bound(F.substring(b, at + 1, F.lit(BLOCK + window - 1)), hot))

    return bound(value.cast("binary"), over)


def allowed(value: Column) -> Column:
    out = value.rlike(ALLOWED[0])
    for pattern in ALLOWED[1:]:
        out = out | value.rlike(pattern)
    return out


def secret_like(least: float, words: str | None = None) -> Callable[[Column], Column]:
    """``words``: one more pattern of the allow-list."""
    return lambda s: ~(allowed(s["value"]) if words is None else allowed(s["value"]) | s["value"].rlike(words)) & reaches(s["value"], least)


def unhidden(spans: Column) -> Column:
    """Of sorted spans, the base ones and those that no span of a lower bar holds: such a span starts before or alike, so the farthest end so far tells."""
    bars = sorted(set(BARS[len(BASE) :]))
    ends = F.transform(spans, lambda s: F.struct(*[F.when(s["rank"] < bar, s["end"]).otherwise(0).alias(f"below_{bar}") for bar in bars]))
    farther = lambda x, y: F.struct(*[F.greatest(x[f"below_{bar}"], y[f"below_{bar}"]).alias(f"below_{bar}") for bar in bars])

    def apart(reach: Column) -> Column:
        def seen(s: Column, i: Column) -> Column:
            out = F.lit(True)
            for rank in range(len(BASE), len(KINDS)):
                out = F.when(s["rank"] == rank, s["end"] > F.get(reach, i)[f"below_{BARS[rank]}"]).otherwise(out)
            return out

        return F.filter(spans, seen)

    return bound(bound(ends, lambda e: running(e, farther)), apart)


def spans_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, base and spans (base ones and those the method adds): arrays of struct(start, rank, kind, end), sorted."""
    whole = F.coalesce(F.col(text), F.lit(""))
    as_span = lambda kind: lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"))
    base = F.array_sort(F.concat(*[F.transform(matches(whole, *BASE[k]), as_span(k)) for k in BASE]))
    classes = CLASSES | NARROW
    more = [F.transform(F.filter(matches(whole, classes[k][0]), secret_like(classes[k][1], MIXED_PATH if k == "entropy_mixed" else None)), as_span(k)) for k in classes]
    found = docs.select("doc_id", base.alias("base"), F.concat(*more).alias("more"))
    return found.select("doc_id", "base", F.when(F.size("more") == 0, F.col("base")).otherwise(bound(F.array_sort(F.concat("base", "more")), unhidden)).alias("spans"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex (long), base_spans, spans."""
    found = spans_of(docs, text)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE], written(F.col("base")).alias("base_spans"), written(F.col("spans")).alias("spans"))
