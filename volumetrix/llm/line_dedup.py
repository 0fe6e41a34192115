"""Line dedup in DataFrame operations only.

Lines are exploded with their positions as 128-bit hashes of their keys and written once as narrow
rows. Distinct documents per hash are counted (copies of a line within a document collapse first, a
hot line is combined before the shuffle), lines over the threshold give the positions that each
document loses, and the texts of those documents are put together again from the positions that
stay. Texts move only if the positions are too many to broadcast, and then past the sort buffers.

Edge cases: a null or empty text is one empty line. Documents are told apart by doc_id: rows that
repeat a doc_id count as one document, and rows with a null doc_id as one that never holds the
stay-behind copy unless it is the only one. A text of any length costs its lines once, however many
it loses; its positions are one array. Other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_checked, materialise

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_DOCS = 40, 5
#: Documents, and lost lines, up to which their positions are broadcast.
BROADCAST_DOCS, BROADCAST_LINES = 5_000, 100_000


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def line_hashes(lines: Column, min_chars: int = MIN_CHARS) -> Column:
    """Two differently seeded 64-bit hashes of each line's key; null for a key that is too short."""
    keys = F.transform(lines, lambda x: F.when(F.char_length(x) >= min_chars, line_key(x)))  # trimming only shortens
    return F.transform(keys, lambda k: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b"))))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def text_hash() -> Column:
    """Tells rows with one doc_id and different texts apart; equal rows lose equal lines."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def long_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """id, t (hash of the text), pos, a, b: every line whose key is long enough."""
    rows = docs.select(F.col("doc_id").alias("id"), text_hash().alias("t"), F.posexplode(line_hashes(lines_of(F.col("text")), min_chars)).alias("pos", "h"))
    return rows.where("h is not null").select("id", "t", "pos", "h.a", "h.b")


def frequent_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """a, b, last: hashes of lines in ``min_docs`` documents or more, and the largest id that holds each."""
    counted = lines.groupBy("a", "b").agg(F.count_distinct(F.struct("id")).alias("n"), F.max("id").alias("last"))
    return counted.where(F.col("n") >= min_docs).select("a", "b", "last")


def lost_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """__vx_id, __vx_t, __vx_lost (positions): one row per document that loses a line."""
    lines = materialise(long_lines(docs, min_chars), "lines-long")
    often = materialise(frequent_lines(lines, min_docs), "lines-often", narrow=True)
    hits = join_checked(lines, often, ["a", "b"]).where(~F.col("id").eqNullSafe(F.col("last")))
    lost = hits.groupBy(F.col("id").alias("__vx_id"), F.col("t").alias("__vx_t")).agg(F.collect_set("pos").alias("__vx_lost"))
    return materialise(lost, "lines-lost", narrow=True)


def _with_lost(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """Adds __vx_lost (null: loses nothing)."""
    rows, lines = lost.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("__vx_lost")), F.lit(0))).first()
    small = rows <= BROADCAST_DOCS and lines <= BROADCAST_LINES
    side = F.broadcast(lost) if small else lost.hint("shuffle_hash")  # hashed, so that texts stream past it and are not sorted
    return docs.join(side, docs["doc_id"].eqNullSafe(F.col("__vx_id")) & (text_hash() == F.col("__vx_t")), "left")


def _marked(docs: DataFrame, min_chars: int, min_docs: int) -> tuple[DataFrame, Column, Column, Column]:
    """The documents with the lines to lose; the shortened text, n_lines and n_dropped as columns over them."""
    joined = _with_lost(docs, lost_lines(docs, min_chars, min_docs))
    whole = F.coalesce("text", F.lit(""))
    n_lines = (F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long")
    # a one-element array binds lines and positions once for the look-ups
    lines = F.split(whole, "\n", -1)
    bound = F.array(F.struct(lines.alias("lines"), F.array_except(F.sequence(F.lit(0), n_lines.cast("int") - 1), F.col("__vx_lost")).alias("stay")))
    shorter = F.get(F.transform(bound, lambda s: F.array_join(F.transform(s["stay"], lambda k: F.get(s["lines"], k)), "\n")), F.lit(0))
    text = F.when(F.col("__vx_lost").isNull(), whole).otherwise(shorter)
    dropped = F.when(F.col("__vx_lost").isNull(), F.lit(0)).otherwise(F.size("__vx_lost")).cast("long")
    return joined, text, n_lines, dropped


def _own(docs: DataFrame, text: Column, without: tuple[str, ...] = ()) -> list[Column]:
    return [F.col(f"`{c}`") if c != "text" else text.alias("text") for c in docs.columns if c.lower() not in without]


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents' columns with the shortened text, plus n_lines, n_dropped (long), which replace columns of these names."""
    cut, text, n_lines, dropped = _marked(docs, min_chars, min_docs)
    return cut.select(*_own(docs, text, ("n_lines", "n_dropped")), n_lines.alias("n_lines"), dropped.alias("n_dropped"))


def shorten(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents with exactly their own columns and the shortened text."""
    cut, text, _, _ = _marked(docs, min_chars, min_docs)
    return cut.select(*_own(docs, text))
