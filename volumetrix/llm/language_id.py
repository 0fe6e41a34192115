"""Language identification by unigrams over a fixed public piece vocabulary, summed over segmentations.

Per language, each vocabulary piece gets a smoothed probability: first from the pieces of labelled
texts as the vocabulary's own segmentation cuts them, then from expected counts over all
segmentations (forward and backward sums, one step of expectation maximisation). A word's probability
in a language is the sum over all its segmentations into pieces (forward algorithm); a text's score is the sum of its words' log probabilities, and the prediction the
language with the highest, score being its posterior under equal priors.

Fitting reads at most about ``TRAIN_DOCS`` labelled texts per language, chosen by a hash of doc_id, of
every language there is. Languages are scored in blocks of ``BLOCK_LANGS``, which bounds what is
collected and broadcast at once (vocabulary x block); up to one block, prediction is one map-only
pass, beyond it a pass per block that carries the best so far. Every whole text is read; words are
scored once per worker while they stay in its bounded cache.

Edge cases: a text that is null or has no letters (number signs like ² are none) is ``und`` with score 0; so is every text if no
labelled text has a word. Words of any length keep only the last ``PIECE_CHARS`` positions. Ties go to the first language in code point order. Repeated rows are
predicted each. Other columns are never read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, join_checked, materialise
from .token_encoder import vocabulary_path

VOCABULARY = "piece_bpe_32k.model"
TRAIN_DOCS, SMOOTHING = 4000, 0.1
#: Languages scored at once; numbers (words x languages) that a step, and the cache of word scores, hold.
BLOCK_LANGS, STEP_CELLS, CACHE_CELLS = 256, 200_000, 1_200_000
UNKNOWN = "und"
#: Longest word whose segmentations are summed in plain floating point; longer ones are rescaled on the way.
PLAIN_CHARS, PIECE_CHARS = 24, 16
#: Probability of a character that no piece covers, alike in all languages.
OUTSIDE = 1e-9
FOLDS, HELD_OUT = 3, 1
_START = "▁"

letters = re.compile(r"[^\W\d_]+").findall
_LOADED: dict[str, object] = {}


def held_out(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string")) % FOLDS == HELD_OUT


def _pieces(path: str):
    if path not in _LOADED:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        known = {model.id_to_piece(k): k for k in range(model.get_piece_size()) if not (model.is_unknown(k) or model.is_control(k) or model.is_byte(k))}
        _LOADED[path] = (model, known)
    return _LOADED[path]


def bounded(labelled: DataFrame, per_lang: int) -> DataFrame:
    """About ``per_lang`` rows of each language: those whose hash of doc_id falls below the share asked for."""
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = materialise(sizes.select("lang", (F.lit(float(per_lang)) / F.col("n")).alias("share")), "lang-shares")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(7), F.col("doc_id")), 11) / F.lit(float(1 << 53))
    return join_checked(labelled, share, "lang").where(draw < F.col("share")).drop("share")


def own_pieces(path: str, words: Counter) -> Counter:
    """Pieces of the words' own segmentations."""
    found: Counter = Counter()
    for pieces, n in zip(_pieces(path)[0].encode(list(words)), words.values()):
        for p in pieces:
            found[p] += n
    return found


def expected_pieces(path: str, words: Counter, probs: np.ndarray) -> Counter:
    """Expected pieces over all segmentations, under one language's probabilities.

    A piece from i to j is in a word's segmentation with probability alpha[i] p beta[j] / alpha[end].
    Words beyond ``PLAIN_CHARS``, where plain numbers would underflow, count by their own segmentation.
    """
    get, none = _pieces(path)[1].get, len(probs)
    table, sums = np.append(probs, [0.0, OUTSIDE]), np.zeros(len(probs) + 2)
    by_size: dict[int, list[str]] = {}
    for w in words:
        by_size.setdefault(len(w) + 1, []).append(w)
    long = Counter({w: words[w] for size, some in by_size.items() if size > PLAIN_CHARS for w in some})
    for size, some in by_size.items():
        if size > PLAIN_CHARS:
            continue
        texts, n = [_START + w for w in some], np.fromiter((words[w] for w in some), float, len(some))
        spans = [(i, j) for j in range(1, size + 1) for i in range(max(0, j - PIECE_CHARS), j)]
        ids = {(i, j): np.fromiter((get(t[i:j], none + (j - i == 1)) for t in texts), np.int64, len(texts)) for i, j in spans}
        alpha, beta = np.zeros((size + 1, len(texts))), np.zeros((size + 1, len(texts)))
        alpha[0] = beta[size] = 1.0
        for i, j in spans:
            alpha[j] += alpha[i] * table[ids[i, j]]
        for i, j in reversed(spans):
            beta[i] += beta[j] * table[ids[i, j]]
        weight = n / alpha[size]
        for i, j in spans:
            sums += np.bincount(ids[i, j], weight * alpha[i] * table[ids[i, j]] * beta[j], len(sums))
    found = Counter({int(k): float(sums[k]) for k in np.flatnonzero(sums[:-2])})
    for p, n in own_pieces(path, long).items() if long else ():
        found[p] += n
    return found


def piece_counts(labelled: DataFrame, vocabulary: str = VOCABULARY, model: "Model | None" = None) -> DataFrame:
    """lang, piece (vocabulary id), n (double): at most languages x vocabulary rows. With ``model``, expected counts of its languages."""
    path = vocabulary_path(vocabulary)
    shared = labelled.sparkSession.sparkContext.broadcast((model.langs, model.table[:-2].astype(np.float32))) if model else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words.setdefault(lang, Counter()).update(letters(text.lower()))
            if sum(map(len, words.values())) > 300_000:
                yield out(words)
                words = {}
        yield out(words)

    def out(words: dict[str, Counter]) -> pa.RecordBatch:
        langs, ids, counts = [], [], []
        for lang, seen in words.items():
            found = expected_pieces(path, seen, shared.value[1][:, shared.value[0].index(lang)].astype(np.float64)) if shared else own_pieces(path, seen)
            langs += [lang] * len(found)
            ids += list(found)
            counts += list(found.values())
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(ids, pa.int32()), pa.array(counts, pa.float64())], names=["lang", "piece", "n"])

    made = labelled.select("lang", "text").mapInArrow(run, "lang string, piece int, n double")
    return made.groupBy("lang", "piece").agg(F.sum("n").alias("n"))


class Model:
    """Some languages, and the probability of each vocabulary piece in each of them."""

    def __init__(self, langs: list[str], probs: np.ndarray, path: str, cells: int = CACHE_CELLS):
        self.langs, self.path = langs, path
        self.table = np.vstack([probs, np.zeros(len(langs)), np.full(len(langs), OUTSIDE)])  # then: no piece, a character outside
        self.places: dict[str, int] = {}
        self.store, self.room = np.empty((0, len(langs))), max(1, cells // max(1, len(langs)))

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word (rows) in each language (columns), over all segmentations."""
        out = np.empty((len(words), len(self.langs)))
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_size.setdefault(len(w) + 1, []).append(k)
        step = max(1, STEP_CELLS // max(1, len(self.langs)))
        for size, at in by_size.items():
            for some in (at[k : k + step] for k in range(0, len(at), step)):
                out[some] = self._scores([_START + words[k] for k in some], size)
        return out

    def _scores(self, texts: list[str], size: int) -> np.ndarray:
        """Words of one length: alpha[j] sums alpha[i] times the probability of the piece from i to j."""
        get, none, outside = _pieces(self.path)[1].get, len(self.table) - 2, len(self.table) - 1
        alpha, logs = [np.ones((len(texts), len(self.langs)))], np.zeros(len(texts))  # the last PIECE_CHARS positions
        for j in range(1, size + 1):
            first = j - len(alpha)
            total = np.zeros((len(texts), len(self.langs)))
            for i, before in enumerate(alpha, first):
                miss = outside if j - i == 1 else none
                ids = np.fromiter((get(t[i:j], miss) for t in texts), np.int64, len(texts))
                total += before * self.table[ids]
            alpha = [*alpha[1 - PIECE_CHARS :], total]
            if size > PLAIN_CHARS and j % 8 == 0:  # rescale what later steps still read
                scale = np.maximum(total.max(axis=1), 1e-300)
                logs += np.log(scale)
                alpha = [a / scale[:, None] for a in alpha]
        return np.log(np.maximum(alpha[-1], 1e-300)) + logs[:, None]

    def _known(self, bags: list[Counter]) -> None:
        """Makes sure that the words of the bags are in the store; words of batches before go when it is full."""
        new = list(dict.fromkeys(w for bag in bags for w in bag if w not in self.places))
        if new and len(self.places) + len(new) > self.room:
            new = list(dict.fromkeys(w for bag in bags for w in bag))
            self.places, self.store = {}, self.store[:0]
        if new:
            self.places.update(zip(new, range(len(self.places), len(self.places) + len(new))))
            self.store = np.concatenate([self.store, self.word_scores(new)])

    def totals(self, texts: list[str | None]) -> Iterator[np.ndarray | None]:
        """Per text the log probability in each language; None for a text without letters."""
        bags = [Counter(letters(t.lower())) if t else Counter() for t in texts]
        if self.langs:
            self._known(bags)
        for bag in bags:
            if not self.langs or not any(any(map(str.isalpha, w)) for w in bag):
                yield None
            else:
                at, n = np.fromiter((self.places[w] for w in bag), np.int64, len(bag)), np.fromiter(bag.values(), float, len(bag))
                yield n @ self.store[at]


def fit(docs: DataFrame, per_lang: int = TRAIN_DOCS, vocabulary: str = VOCABULARY, smoothing: float = SMOOTHING, block: int = BLOCK_LANGS) -> Iterator[Model]:
    """Models of all languages of the labelled rows (doc_id, text, lang; nulls left out), a block at a time, in code point order."""
    bounded_batches(docs)
    labelled = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    labelled = materialise(bounded(labelled, per_lang).select("lang", "text"), "lang-train")
    path = vocabulary_path(vocabulary)
    size = _pieces(path)[0].get_piece_size()
    own = materialise(piece_counts(labelled, vocabulary), "lang-pieces")
    langs = sorted(r.lang for r in own.select("lang").distinct().toLocalIterator())  # names alone

    def model(counted: DataFrame, some: list[str]) -> Model:
        at, counts = {x: j for j, x in enumerate(some)}, np.full((size, len(some)), smoothing)
        rows = counted.toArrow()  # vocabulary x block at most
        counts[rows["piece"].to_numpy(), [at[x] for x in rows["lang"].to_pylist()]] += rows["n"].to_numpy()
        return Model(some, counts / counts.sum(axis=0, keepdims=True), path)

    for k in range(0, len(langs), block):
        some = langs[k : k + block]
        inside = (F.col("lang") >= some[0]) & (F.col("lang") <= some[-1])
        first = model(own.where(inside), some)
        yield model(piece_counts(labelled.where(inside), vocabulary, first), some)


def _pass(rows: DataFrame, model: Model | None, kept: list, last: bool) -> DataFrame:
    """One block of languages over all rows: the best so far, its total, and the sum of all probabilities over it."""
    shared = rows.sparkSession.sparkContext.broadcast((model.langs, model.table[:-2].astype(np.float32), model.path)) if model else None
    state = [T.StructField("lang_pred", T.StringType()), T.StructField("__vx_top", T.DoubleType()), T.StructField("__vx_mass", T.DoubleType())]
    out = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]) if last else T.StructType([*kept, T.StructField("__vx_text", T.StringType()), *state])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = Model(shared.value[0], shared.value[1].astype(np.float64), shared.value[2]) if shared else Model([], np.empty((0, 0)), "")
        for batch in batches:
            for part in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                langs, tops, masses = (c.to_pylist() for c in part.columns[len(kept) + 1 :])
                for k, total in enumerate(local.totals(part.column(len(kept)).to_pylist())):
                    if total is not None:
                        best = int(total.argmax())
                        top = max(tops[k], float(total[best]))
                        masses[k] = masses[k] * math.exp(tops[k] - top) + float(np.exp(total - top).sum())
                        langs[k] = local.langs[best] if total[best] > tops[k] else langs[k]
                        tops[k] = top
                found = [langs, [1 / m if m else 0.0 for m in masses]] if last else [part.column(len(kept)), langs, tops, masses]
                kinds = (pa.string(), pa.float64()) if last else (pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *[c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(found, kinds)]], names=out.names)

    return rows.mapInArrow(run, out)


def predict(docs: DataFrame, models: Iterator[Model], *keep: Column) -> DataFrame:
    """``keep`` columns, lang_pred, score. Map-only; with several blocks each but the last writes what it has."""
    bounded_batches(docs)
    rows = docs.select(*keep, F.col("text").cast("string").alias("__vx_text"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(float("-inf")).alias("__vx_top"), F.lit(0.0).alias("__vx_mass"))
    kept = rows.schema.fields[: len(keep)]
    model = next(models, None)
    while model is not None and (following := next(models, None)) is not None:
        rows, model = materialise(_pass(rows, model, kept, last=False), "lang-pass"), following
    return _pass(rows, model, kept, last=True)


def identify(docs: DataFrame, per_lang: int = TRAIN_DOCS, block: int = BLOCK_LANGS) -> DataFrame:
    """doc_id, held_out, lang_pred, score: fitted outside the held-out fold, predicted everywhere."""
    models = fit(docs.where(~F.coalesce(held_out(), F.lit(False))), per_lang, block=block)
    return predict(docs, models, F.col("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"))
