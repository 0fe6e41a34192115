"""Each operator against a brute-force version, and the edge cases its docstring defines."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from volumetrix.llm import exact_dedup, language_id, license_scan, line_dedup, mixing, packing, quality_rules, secret_scan, simhash_dedup, token_counts
from volumetrix.llm.token_encoder import WordEncoder, vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, KEPT int, `at.b` string"
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
LONG = "word " * 30_000 + "password = hunter2hunter2"


def frame(spark, texts, ids=None, langs=None, sources=None, parts=3):
    rows = [(i, t, la, s, 1, "h", 1, "x") for i, t, la, s in zip(ids or range(len(texts)), texts, langs or ["en"] * len(texts), sources or ["src1"] * len(texts))]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéñst") for _ in range(rng.randint(2, 9))) for _ in range(200)]
    common = [" ".join(rng.choices(vocab, k=12)) for _ in range(6)]
    out = []
    for k in range(n):
        lines = [rng.choice(common) if rng.random() < 0.3 else " ".join(rng.choices(vocab, k=rng.randint(1, 25))) for _ in range(rng.randint(1, 8))]
        lines = [x.upper() if rng.random() < 0.1 else "  " + x + "\t" if rng.random() < 0.1 else x for x in lines]
        out.append(("\r\n" if rng.random() < 0.1 else "\n").join(lines))
    out += out[:10] + [out[3]] * 7
    return out + [None, "", " ", "\n\n", "a", "日本語 テキスト\u0085x y", LONG]


# quality rules


def brute_quality(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    many = {w for w, n in Counter(windows).items() if n > 1}
    covered = {k + d for k, w in enumerate(windows) if w in many for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def test_quality_counts(spark):
    texts = corpus() + ["x y z " * 40, "a#b *$%&|<> " * 20, "l\nl\n\n \nl"]
    got = quality_rules.quality_verdicts(frame(spark, texts), labels(spark, [(1, 1, 0, "x"), (None, 1, 0, "x"), (2, None, 0, "x"), (10**9, 0, 0, "x")])).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute_quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed)  # too few labels to certify anything


def test_quality_cutoffs_hold_their_guarantee(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    good = [" ".join(word() for _ in range(60)) for _ in range(1800)]
    bad = [" ".join(word() + "***" for _ in range(60)) for _ in range(200)]
    docs = frame(spark, good + bad + [" ".join(word() + "###" for _ in range(60))], langs=["en"] * 2000 + ["rare"])
    marks = labels(spark, [(k, int(k < 1800), 0, "") for k in range(2001)])
    verdict = {r.doc_id: r.kept for r in quality_rules.quality_verdicts(docs, marks).collect()}
    assert not any(verdict[k] for k in range(1800, 2000))
    assert sum(not verdict[k] for k in range(1800)) <= 0.02 * 1800
    assert verdict[2000]  # its stratum has too few labels
    kept = quality_rules.quality_filter(docs, marks)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, v in verdict.items() if v}


def test_binomial_tail_is_exact():
    for n, p in ((5, 0.3), (60, 0.01)):
        for k in range(n + 1):
            want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert quality_rules.binomial_tail(k, n, p) == pytest.approx(want, rel=1e-9)
    n = quality_rules.least_good(0.01, 0.05)
    assert quality_rules.binomial_tail(0, n, 0.01) <= 0.05 < quality_rules.binomial_tail(0, n - 1, 0.01)


# mixing


def brute_fill(budget, caps, weights):
    share, left = [0.0] * len(caps), budget
    live = {k for k in range(len(caps)) if weights[k] > 0 and caps[k] > 0}
    while live:
        level = left / sum(weights[k] for k in live)
        full = {k for k in live if caps[k] <= level * weights[k]}
        if not full:
            for k in live:
                share[k] = level * weights[k]
            break
        for k in full:
            share[k] = caps[k]
            left -= caps[k]
        live -= full
    return share


def test_water_filling(spark):
    rng = random.Random(2)
    for _ in range(4):
        n = rng.randint(1, 7)
        caps, weights, budget = [rng.randint(1, 1000) for _ in range(n)], [rng.choice([0.0, 1.0, 2.5]) for _ in range(n)], rng.randint(0, 3000)
        df = spark.createDataFrame([(f"d{k}", caps[k], weights[k], budget) for k in range(n)], f"{mixing.LEVELS[0]} string, cap long, weight double, budget long")
        got = {r[0]: r["share"] for r in mixing.water_fill(df, []).collect()}
        for k, want in enumerate(brute_fill(budget, caps, weights)):
            assert abs(got.get(f"d{k}", 0) - want) <= 1


@pytest.mark.parametrize("epochs, share", [(1, 0.8), (4, 0.8), (3, 2.5), (2, 0.0)])
def test_mixture_takes_prefixes_of_seeded_epochs(spark, epochs, share):
    rng = random.Random(3)
    texts = corpus(4, 300)
    langs = [rng.choice(["en", "de", "fr", None]) for _ in texts]
    sources = [rng.choice(["src0", "src0", "src1", "src2", "src7", None]) for _ in texts]
    docs = frame(spark, texts, langs=langs, sources=sources)
    rows = mixing.mixture(docs, share, epochs).collect()
    assert len(rows) == len(texts)
    leaf = defaultdict(list)
    for r in rows:
        leaf[r.domain, r.lang, r.source].append(r)
    total = sum(r.n_tokens for r in rows)
    tree: dict = {}
    for (d, la, s), members in leaf.items():
        tree.setdefault(d, {}).setdefault(la, {})[s] = sum(r.n_tokens for r in members)
    weight = lambda level, x: (mixing.DOMAIN_WEIGHTS.get(x, 0.0), mixing.LANG_WEIGHTS.get(x, 0.05), 1.0)[level]
    supply = lambda t: t * epochs if not isinstance(t, dict) else sum(map(supply, t.values()))
    budgets = {}

    def spread(node, budget, path):
        names = list(node)
        for x, b in zip(names, brute_fill(budget, [supply(node[x]) for x in names], [weight(len(path), x) for x in names])):
            if isinstance(node[x], dict):
                spread(node[x], int(b), (*path, x))
            else:
                budgets[*path, x] = b

    spread(tree, int(total * share), ())
    for key, members in leaf.items():
        tokens, budget = sum(r.n_tokens for r in members), budgets.get(key, 0)
        taken = sum(r.epochs * r.n_tokens for r in members)
        assert taken <= budget + 1
        whole = min(r.epochs for r in members)
        assert max(r.epochs for r in members) <= min(whole + 1, epochs)
        if max(r.epochs for r in members) > whole or taken < budget - 4:
            order = sorted(members, key=lambda r: shuffled(spark, whole, r.doc_id))
            assert [r.epochs for r in order] == sorted((r.epochs for r in members), reverse=True)
            more = next((r.n_tokens for r in order if r.epochs == whole), None)
            assert more is None or taken + more > budget - 4
    mixed = mixing.mix(docs, share, epochs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.epochs for r in rows if r.epochs})


def test_mixture_of_a_large_group_without_ids(spark):
    """Rows without an id share one place in the order: they are taken alike, and summed before they meet."""
    docs = frame(spark, [f"some words {k % 7}" for k in range(3000)] + ["one more text"] * 1500, ids=[None] * 3000 + list(range(1500)))
    rows = mixing.mixture(docs, 0.5, 1).collect()
    assert len(rows) == 4500 and len({r.epochs for r in rows if r.doc_id is None}) == 1
    taken, total = sum(r.epochs * r.n_tokens for r in rows), sum(r.n_tokens for r in rows)
    assert taken <= 0.5 * total + 1


def shuffled(spark, epoch, doc_id, seed=mixing.SEED):
    h = 42
    for x in (np.int32(seed), np.int64(epoch), np.int64(doc_id)):
        h = hash_fixed(int(x), isinstance(x, np.int32), h)
    return h >> 1


def hash_fixed(x, short, seed):
    """XXH64 of a little-endian integer, as Spark chains it."""
    return xxhash.xxh64_intdigest((x & (2**32 - 1 if short else 2**64 - 1)).to_bytes(4 if short else 8, "little"), seed)


# line dedup


def brute_lines(rows, min_chars, min_docs):
    key = lambda line: re.sub(r"[A-Z]", lambda m: m[0].lower(), re.sub(rf"^{SPACE}+|{SPACE}+$", "", line))
    where = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                where[key(line)].add(i)
    gone = {k: max(v) for k, v in where.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in gone or gone[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out)


@pytest.mark.parametrize("repeat, broadcast", [(False, True), (True, True), (True, False)])
def test_line_dedup(spark, monkeypatch, repeat, broadcast):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", line_dedup.BROADCAST_LINES if broadcast else -1)
    texts = corpus()
    ids = list(range(len(texts)))
    if repeat:
        texts, ids = texts + texts[:60], ids + ids[:60]
    got = line_dedup.dedup_lines(frame(spark, texts, ids))
    assert set(got.columns) == {"doc_id", "text", "lang", "source", "n_chars", "h", "KEPT", "at.b", "n_lines", "n_dropped"}
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == brute_lines(list(zip(ids, texts)), 40, 5)
    assert any(r[2] for r in brute_lines(list(zip(ids, texts)), 40, 5))


def test_line_dedup_of_many_lost_lines(spark):
    """Texts that lose nearly all of their many lines, in time that follows their length; one id with two texts."""
    lines = [f"a shared line of more than forty characters {k:06d}" for k in range(20_000)]
    texts = ["\n".join(["own line of document", *lines[k:], "x" * k]) for k in range(6)] + ["\n".join(lines[:9]), "\n".join(lines[5:7])]
    ids = [0, 1, 2, 3, 4, 5, 5, None]
    began = time.perf_counter()
    got = line_dedup.dedup_lines(frame(spark, texts, ids)).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert time.perf_counter() - began < 60
    key = lambda r: (r[0] is None, r)
    rows = [(-1 if i is None else i, t) for i, t in zip(ids, texts)]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got) == sorted(brute_lines(rows, 40, 5), key=key)


# licences


def test_licenses(spark):
    s = license_scan.SENTENCES
    mit = "\n".join(["Copyright 2020", s["mit-title"], "", s["mit-grant"], s["mit-notice"], s["mit-warranty"]])
    bsd2 = "\n".join([s["bsd-grant"], "* " + s["bsd-source"], "* " + s["bsd-binary"]])
    texts = [mit, bsd2, bsd2 + "\n" + s["bsd-endorse"], "prose.\n" + s["apache-line"] + "\nmore", s["cc-by-nc-line"] + " " + s["gpl3-line"], "no terms here", None, "", s["mit-grant"] + "\n" + "x.\n" * 4 + s["mit-notice"], s["bsd-source"] + " " + s["bsd-grant"], LONG + "\nlicense", "\n\n".join(x.replace(", ", ",\n") for x in mit.split("\n"))]
    got = {r.doc_id: r for r in license_scan.scan_licenses(frame(spark, texts)).collect()}
    assert [got[k].licenses for k in range(12)] == ["MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-3.0-only,CC-BY-NC-4.0", "", "", "", "MIT", "", "", "MIT"]
    assert got[0].sentence_ids == "mit-title,mit-grant,mit-notice,mit-warranty"
    assert set(license_scan.table().values()) == set(s)
    assert all(re.search(license_scan.CUES, s[ids[0]]) for _, ids in license_scan.RULES)


def test_licenses_of_padded_sentences(spark):
    """Any filling around and inside a sentence, and other sentences of any length, hide nothing."""
    line = license_scan.SENTENCES["apache-line"]
    texts = ["#" * 5000 + " " + line, line.replace(" ", " " * 1000), "/" * 100_000 + line + "*" * 2000, "x" * 50_000 + ".\n" + line, "// SPDX-License-Identifier: AGPL-3.0-only", "word. " * 7]
    got = {r.doc_id: r for r in license_scan.scan_licenses(frame(spark, texts)).collect()}
    assert [got[k].licenses for k in range(6)] == ["Apache-2.0"] * 4 + ["AGPL-3.0-only", ""]
    assert [got[k].n_sentences for k in (3, 4, 5)] == [2, 1, 8]


def test_licenses_of_both_readings(spark):
    """Wrapped and unwrapped notices in one text are all found, and no rule sees a sentence twice."""
    s = license_scan.SENTENCES
    cc = s["cc-by-sa-long"].replace("Commons ", "Commons\n")
    bsd = [s["bsd-grant"], s["bsd-source"], s["bsd-binary"], s["bsd-endorse"].replace("used to ", "used to\r\n")]
    texts = [cc + "\n\nMIT License\nCopyright (c) 2020 X", "MIT License\nCopyright (c) 2020 X\n\n" + cc, "\n\n".join([cc, s["cc0-line"].replace("public ", "public\n"), "MIT License\nCopyright X"]), "\n\n".join(bsd) + "\n\nMIT License\nby X", s["mit-line-2"].replace("the ", "the\n")]
    got = {r.doc_id: r for r in license_scan.scan_licenses(frame(spark, texts)).collect()}
    assert [set(got[k].licenses.split(",")) for k in range(5)] == [{"MIT", "CC-BY-SA-4.0"}, {"MIT", "CC-BY-SA-4.0"}, {"MIT", "CC0-1.0", "CC-BY-SA-4.0"}, {"MIT", "BSD-3-Clause"}, {"MIT"}]
    assert (got[0].sentence_ids, got[0].n_sentences) == ("cc-by-sa-long,mit-title-2", 3)


def test_licenses_wrapped_at_any_blank(spark):
    """Each known sentence alone in its text, whole, wrapped at every blank and with blanks doubled, is known."""
    first = {name: re.split(license_scan.BREAK, x)[0] for name, x in license_scan.SENTENCES.items()}
    cases = [(n, v) for n, x in first.items() for v in [x, x.replace(" ", "  "), *(x[: m.start()] + e + x[m.end() :] for m in re.finditer(" ", x) for e in ("\n", "\r\n"))]]
    got = {r.doc_id: r.sentence_ids for r in license_scan.scan_licenses(frame(spark, [v for _, v in cases])).collect()}
    own = lambda n: license_scan.table()[license_scan.normalised_text(first[n])]
    # a wrap can leave a shorter known sentence of the same licence alone on its line
    shorter = lambda n, x: n.split("-")[0] in ("mit", "apache") and x in [k for k in first if k.split("-")[0] == n.split("-")[0]]
    wrong = [(cases[k], got[k]) for k in got if got[k] != own(cases[k][0]) and not shorter(cases[k][0], got[k])]
    assert not wrong, wrong[:5]


# exact dedup


@pytest.mark.parametrize("bits", [exact_dedup.MAX_BITS, 1 << 11])
def test_exact_groups(spark, bits):
    """With one plane, and with ranges that have a plane each."""
    texts = corpus(n=400)
    assert (exact_dedup.ranges_for(len(texts), bits) > 2) == (bits == 1 << 11)
    rows = exact_dedup.exact_groups(frame(spark, texts), max_bits=bits).collect()
    groups = defaultdict(list)
    for k, t in enumerate(texts):
        groups[t or ""].append(k)
    assert len(rows) == len(texts)
    for r in rows:
        own = groups[texts[r.doc_id] or ""]
        assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), r.doc_id == max(own))
        assert r.text_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    kept = exact_dedup.drop_exact_duplicates(frame(spark, texts), max_bits=bits)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(max(g) for g in groups.values())


def test_exact_groups_with_repeated_rows(spark):
    rows = exact_dedup.exact_groups(frame(spark, ["a", "a", "a", "b", None], [1, 2, 2, None, None])).collect()
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in rows) == [(-1, -1, 1, True), (-1, -1, 1, True), (1, 2, 3, False), (2, 2, 3, False), (2, 2, 3, True)]


# language id


def brute_forward(model, word):
    known = language_id._pieces(model.path)[1]
    w, out = "▁" + word, []
    for k in range(len(model.langs)):
        a = [1.0] + [0.0] * len(w)
        for j in range(1, len(w) + 1):
            for i in range(max(0, j - language_id.PIECE_CHARS), j):
                p = known.get(w[i:j])
                a[j] += a[i] * (model.table[p, k] if p is not None else language_id.OUTSIDE if j - i == 1 else 0.0)
        out.append(math.log(a[-1]))
    return out


def brute_identify(model, text):
    """Prediction and posterior of a text, word by word."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not any(c.isalpha() for w in words for c in w):
        return "und", 0.0
    total = np.sum([brute_forward(model, w) for w in words], axis=0)
    return model.langs[int(total.argmax())], float(1 / np.exp(total - total.max()).sum())


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labelled = docs.where(~language_id.held_out())
    model, = language_id.fit(labelled)
    words = ["the", "étrechai", "x", "日本", "a" * 20, "thoringthand" * 3]
    assert np.allclose(model.word_scores(words), [brute_forward(model, w) for w in words])
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    for r in sorted(rows, key=lambda r: len(r.text or ""))[:40]:
        lang, score = brute_identify(model, r.text)
        assert r.lang_pred == lang and r.score == pytest.approx(score, rel=1e-3)
    odd = language_id.predict(frame(spark, [None, "", "12 % ² Ⅷ", LONG, "日本" * 20_000]), iter([model]), language_id.F.col("doc_id")).collect()
    assert {r.doc_id: r.lang_pred for r in odd if r.doc_id < 3} == {0: "und", 1: "und", 2: "und"} and len(odd) == 5
    assert language_id.identify(frame(spark, ["abc", "def"], langs=[None, None])).select("lang_pred").distinct().collect() == [("und",)]


def segmentations(word, known):
    """All ways to cut a word into pieces, single characters that are none included."""
    if not word:
        yield []
    for k in range(1, min(len(word), language_id.PIECE_CHARS) + 1):
        if k == 1 or word[:k] in known:
            yield from ([word[:k], *rest] for rest in segmentations(word[k:], known))


def test_language_id_fits_expected_pieces(spark):
    """Probabilities are smoothed expected counts over all segmentations, by listing them; a small cache changes nothing."""
    texts, langs = ["The cat, the dog.", "der Hund und der Hund", "le chien 日", "the end"], ["en", "de", "fr", "en"]
    model, = language_id.fit(frame(spark, texts, langs=langs))
    pieces, known = language_id._pieces(model.path)
    size, smooth = pieces.get_piece_size(), language_id.SMOOTHING
    for k, lang in enumerate(model.langs):
        words = Counter(w for t, la in zip(texts, langs) if la == lang for w in re.findall(r"[^\W\d_]+", t.lower()))
        first, seen = np.full(size, smooth), np.full(size, smooth)
        for w, n in words.items():
            for p in pieces.encode(w):
                first[p] += n
        first /= first.sum()
        for w, n in words.items():
            ways = [(way, math.prod(first[known[x]] if x in known else language_id.OUTSIDE for x in way)) for way in segmentations("▁" + w, known)]
            for way, p in ways:
                for x in way:
                    if x in known:
                        seen[known[x]] += n * p / sum(q for _, q in ways)
        assert np.allclose(model.table[:-2, k], seen / seen.sum(), rtol=1e-4)
    small = language_id.Model(model.langs, model.table[:-2], model.path, cells=9)
    parts = [["the cat", "der Hund"], ["le chien the", None], ["the end of the cat and the dog der"], ["der"]]
    assert all((x is None) == (y is None) and (x is None or np.allclose(x, y)) for p in parts for x, y in zip(small.totals(p), model.totals(p)))


@pytest.mark.parametrize("block", [256, 500, 2000])
def test_language_id_of_many_languages(spark, block):
    """None of 1,200 languages is left out; blocks of languages give what one block gives."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(1200)]
    docs = frame(spark, [f"{w} " * 5 for w in words] + [None], langs=[f"l{k:04d}" for k in range(1200)] + ["x"])
    rows = language_id.predict(docs, language_id.fit(docs, block=block), language_id.F.col("doc_id")).collect()
    assert sum(r.lang_pred == f"l{r.doc_id:04d}" for r in rows) >= 1190 and all(0 < r.score <= 1 for r in rows if r.doc_id < 1200)


# secrets


def brute_base(text):
    found = []
    for rank, (kind, pattern, group, least) in enumerate((("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))):
        found += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text, re.A) if len(m[group]) >= least]
    return sorted(found)


def entropy_peak(s, window=secret_scan.WINDOW):
    cut = [s[k : k + window] for k in range(max(1, len(s) - window + 1))]
    return max(-sum(n / len(c) * math.log2(n / len(c)) for n in Counter(c).values()) for c in cut)


def brute_extra(text, base):
    """Spans by entropy: hidden by a base span, a narrow one by any of a kind before it too."""
    found = []
    for rank, (kind, (pattern, least)) in enumerate((secret_scan.CLASSES | secret_scan.NARROW).items(), 3):
        words = (*secret_scan.ALLOWED, *([secret_scan.MIXED_PATH] if kind == "entropy_mixed" else []))
        found += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if entropy_peak(m[0]) >= least - 1e-12 and not any(re.search(p, m[0]) for p in words)]
    hides = lambda b, x: b[0] <= x[0] and x[3] <= b[3] and b[1] < (3 if x[1] < 5 else x[1])
    return sorted(x for x in found if not any(hides(b, x) for b in base + found))


def test_secrets(spark):
    rng = random.Random(9)
    code = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    alnum, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef"
    texts = corpus(n=20) + [
        "token=token=abcdefgh secret: token: abcdefg", "PASSWORD = \"" + code(alnum, 12) + "\" api_key:'x'", "AKIA" + code("ABCDEF0123", 16) + " AKIA123 AKIA" + code("XYZ1", 30),
        code(hexa, 40) + " " + code(hexa, 23) + " é日" + code(hexa, 64), "key " + code(alnum, 40) + " and " + code(alnum, 24), "123e4567-e89b-12d3-a456-426614174000", "aaaaaaaaaaaaaaaaaaaaaaaaa1", "path/to/some/long/place/of/files1",
        code(hexa.upper(), 32), "token: " + code(alnum, 300), "é" * 10 + "passwd=" + code(alnum, 8) + "\n" + code(alnum, 50) + "==",
    ]
    got = {r.doc_id: r for r in secret_scan.scan_secrets(frame(spark, texts)).collect()}
    for k, text in enumerate(texts):
        base = brute_base(text or "")
        extra = brute_extra(text or "", base)
        write = lambda rows: ",".join(f"{x[2]}:{x[0]}:{x[3]}" for x in rows)
        assert got[k].base_spans == write(base)
        assert got[k].spans == write(sorted(base + extra))
        assert (got[k].n_assign, got[k].n_access, got[k].n_hex) == tuple(sum(x[2] == kind for x in base) for kind in secret_scan.BASE)
    assert any("entropy" in r.spans for r in got.values())


def test_secrets_recall_per_alphabet(spark):
    """Random keys in whole texts: per alphabet and length at least 96 of 100 with a letter and a digit are found."""
    rng = random.Random(17)
    up, low, ten = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = {"lower": low + ten, "upper": up + ten, "base32": up + "234567", "hex": ten + "ABCDEF", "base62": up + low + ten, "base64": up + low + ten + "+/", "url": up + low + ten + "-_"}
    keys = []
    for name, chars in alphabets.items():
        for n in (20, 24, 32, 40):
            while sum(k[:2] == (name, n) for k in keys) < 100:
                key = "".join(rng.choice(chars) for _ in range(n))
                if {*key} & {*ten} and {*key} - {*ten}:
                    keys.append((name, n, key))
    found = {r.doc_id: r.spans for r in secret_scan.scan_secrets(frame(spark, [f"the key {k} was here" for *_, k in keys])).collect()}
    missed = Counter(k[:2] for i, k in enumerate(keys) if not any(x.endswith(f":8:{8 + k[1]}") for x in found[i].split(",")))
    assert all(n <= 4 for n in missed.values()), missed


def test_secrets_beside_placeholders(spark):
    """A placeholder hides no key beside it, and words, paths and placeholders are no keys."""
    key, small = "Zx9Kq2Lm7Rt4Wv8Yp3Nc6Bd1", "i2iiaannkksum8nlmytbx0kj"
    texts = [f"example/{key}", f"{key}_xxxx", f"0123456789/{small}", f"see {small} here", "your-example-key-goes-here-1", "sk_live_xxxxxxxxxxxxxxxxxxxxxxxx1", "0123456789abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
             "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "Src/Main/Test2/Src/Main/Test3", "id/123e4567-e89b-12d3-a456-426614174000"]
    got = {r.doc_id: r.spans for r in secret_scan.scan_secrets(frame(spark, texts)).collect()}
    assert got[0].startswith("entropy_base64:0:") and got[1].startswith("entropy_base64:0:")
    assert got[2].split(",")[0] in ("entropy_base64:0:35", "entropy_lower:11:35") and got[3] == "entropy_lower:4:28"
    assert [got[k] for k in range(4, len(texts))] == [""] * 7


def test_secrets_in_very_long_candidates_and_many_matches(spark):
    """Candidates of a megabyte, paths of words among them, and 100,000 matches, in time that follows the length."""
    rng = random.Random(23)
    low = "".join(rng.choice("kx") + "0" * (k % 3 == 0) for k in range(600_000))
    texts = ["a1/" * 350_000, "Ab1/" * 250_000, "x" * 1_000_000 + "1", low, "kx12" * 250_000, " ".join(f"{k:024x}" for k in range(100_000)), " ".join(f"token={k:08d}" for k in range(50_000)), "A1" * 30 + "/" + "".join(rng.choice("ABCDEFabcdef0123456789xyz") for _ in range(1_000_000))]
    began = time.perf_counter()
    got = {r.doc_id: r for r in secret_scan.scan_secrets(frame(spark, texts, parts=4)).collect()}
    assert time.perf_counter() - began < 120
    assert [got[k].spans for k in range(5)] == [""] * 5
    assert got[5].n_hex == 100_000 and got[5].base_spans.endswith(f"hex:{25 * 99_999}:{25 * 99_999 + 24}")
    assert got[6].n_assign == 50_000 and got[6].spans == got[6].base_spans
    assert got[7].spans.startswith("entropy_base64:0:")


# packing and token counts


def reference_ids(texts):
    """Ids by a tokenizer of its own, just as it is loaded."""
    return [x.ids for x in Tokenizer.from_file(vocabulary_path()).encode_batch(list(texts), add_special_tokens=False)]


def test_encoder_matches_the_tokenizer():
    """Every character that takes the short way, and others, in several settings; strings of added tokens."""
    enc = WordEncoder(vocabulary_path(), entries=50)
    texts = [t or "" for t in corpus(n=60)[:-1]] + ["don't İstanbul ΣΑΣ \x1c 日本 ''s 'll", " a  b\n\nc ", "we'LL '' x²½ _a_ …‘s", "<|endoftext|> a", "a <|endoftext|> b", "x<|startoftext|>Y <|ENDOFTEXT|> <|endoftext|", "é", "ǅ Ǆ ß ẞ", "x" * 5000]
    chars = [chr(c) for c in (*range(1, 0x300), *range(0x1E00, 0x2100)) if not 0x7F <= c <= 0x9F]
    texts += [t for c in chars for t in (c, f"a{c}b", f"1{c}2", f"'{c}'s", f"{c}{c} {c}.")]
    assert sum(map(enc.is_plain, texts)) > 2000
    assert [x.tolist() for x in enc.encode(texts)] == reference_ids(texts)


def test_packing(spark):
    texts = corpus(n=200) + ["one two three " * 3000, "a <|endoftext|> b Ɓc"]
    rows = packing.pack_documents(frame(spark, texts), shard_rows=60).collect()
    want = {}
    for k, ids in enumerate(reference_ids(t or "" for t in texts)):
        ids = ids + [0]
        for p, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[k, p] = (at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    assert len(rows) == len(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 2048


def test_packing_spreads_repeated_rows(spark):
    docs = frame(spark, ["one two three four"] * 4000, ids=[7] * 4000)
    parts = packing.materialise(packing.pieces(docs), "test-pieces")
    rows = packing.pack(parts, shard_rows=500).collect()
    assert len(rows) == 4000 and max(Counter(r.sequence_id >> 32 for r in rows).values()) < 700
    assert {r.offset % r.length for r in rows} == {0} and len({(r.sequence_id, r.offset) for r in rows}) == 4000


def test_sum_of_squares_rule():
    rng = random.Random(1)
    for _ in range(30):
        size = rng.randint(3, 20)
        lengths = [rng.randint(1, size) for _ in range(60)]
        bins, offsets = packing.sum_of_squares(lengths, size)
        gaps: dict[int, int] = {}
        cost = lambda: sum(n * n for g, n in Counter(gaps.values()).items() if g)
        for n, b, o in zip(lengths, bins, offsets):
            tries = []
            for gap in {size, *gaps.values()}:
                if gap >= n:
                    name = "new" if gap == size else next(k for k, g in gaps.items() if g == gap)
                    before = gaps.get(name)
                    gaps[name] = gap - n
                    tries.append(cost())
                    gaps.pop(name) if before is None else gaps.update({name: before})
            assert o == size - gaps.get(b, size)
            gaps[b] = gaps.get(b, size) - n
            assert cost() == min(tries)


def test_token_counts(spark):
    texts = corpus(n=150) + ["a <|endoftext|> b Ɓc"]
    n = [len(ids) for ids in reference_ids(t or "" for t in texts)]
    sums = token_counts.token_counts(frame(spark, texts))
    rows = {r.length: r for r in sums.collect()}
    assert set(rows) == set(n)
    for c, r in rows.items():
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == (n.count(c), sum(x >= c for x in n), sum(x for x in n if x >= c))
        assert (r.total_docs, r.total_tokens, r.truncated_tokens) == (len(n), sum(n), sum(min(x, c) for x in n))
        assert r.share_within == pytest.approx(sum(x <= c for x in n) / len(n))
    limits = [0, 1, 17, 500, 10**6]
    assert {r.limit: (r.truncated_tokens, r.docs_over) for r in token_counts.at_limits(sums, limits).collect()} == {c: (sum(min(x, c) for x in n), sum(x > c for x in n)) for c in limits}


# simhash


def brute_fingerprint(text):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fps, threshold=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= threshold:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(k) for k in range(len(fps))]


def test_simhash_components(spark):
    rng = random.Random(6)
    texts = corpus(n=60)
    for t in texts[:20]:
        words = t.split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    fps = [brute_fingerprint(t) for t in texts]
    want = brute_components(fps)
    docs = frame(spark, texts)
    for rows in (simhash_dedup.GROUP_ROWS, 1):
        got = {r.doc_id: r for r in simhash_dedup.near_duplicate_components(docs, group_rows=rows).collect()}
        assert [got[k].fingerprint for k in range(len(texts))] == [f"{x:016x}" for x in fps]
        assert [got[k].component_id for k in range(len(texts))] == want
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_keep_one_where_ids_repeat(spark):
    """Rows with one id or none, of different components, all stay; of each component one row does."""
    rng = random.Random(9)
    a, b, c, d, e = (" ".join(str(rng.random()) for _ in range(80)) for _ in range(5))
    rows = [(1, a), (1, b), (2, a), (2, a), (None, c), (None, d), (None, d), (None, b), (None, None), (3, ""), (3, e)]
    docs = frame(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    want = [(1, a), (1, b), (None, c), (None, d), (3, ""), (3, e)]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(want)


def test_links_lose_nothing(spark):
    rng = random.Random(8)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    fps = [rng.getrandbits(64) for _ in range(150)]
    for x in fps[:80]:
        y = x
        for _ in range(rng.randint(1, 5)):
            y = flip(y, rng.randint(1, 6))
            fps.append(y)
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    distinct = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    want = brute_components(fps)
    for rows in (50_000, 2):
        met = simhash_dedup.met(distinct, group_rows=rows)
        n = simhash_dedup.figures(met)
        assert n["links"] <= n["survivors"] <= 0.1 * n["pairs"] + 2 * n["links"] and (rows == 2 or n["links"] > 0)
        roots = {r.node: r.root for r in simhash_dedup.connected(simhash_dedup.links(met)).collect()}
        mine = [roots.get(x, x) for x in signed]
        assert len({(a, b) for a, b in zip(mine, want)}) == len(set(mine)) == len(set(want))


@pytest.mark.parametrize("n", [50, 400, 1500])
def test_pivot_rows_discard(spark, n):
    """Fingerprints that share two blocks all meet; the rows discard nearly all pairs, and links are those of brute force."""
    rng = random.Random(n)
    low = rng.getrandbits(21)
    fps = {low | rng.getrandbits(43) << 21 for _ in range(n)}
    fps |= {x ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for x in sorted(fps)[: n // 5]}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    met = simhash_dedup.met(spark.createDataFrame([(x,) for x in signed], "fp long").repartition(2))
    got = simhash_dedup.figures(met)
    assert got["pairs"] > 5 * len(fps) and got["pairs"] - got["survivors"] > 0.95 * (got["pairs"] - got["links"])
    roots = {r.node: r.root for r in simhash_dedup.connected(simhash_dedup.links(met)).collect()}
    mine, want = [roots.get(x, x) for x in signed], brute_components([x % (1 << 64) for x in signed])
    assert len({*zip(mine, want)}) == len({*mine}) == len({*want}) < len(fps)


# empty tables


@pytest.mark.parametrize("run", [
    lambda d: quality_rules.quality_verdicts(d, d.sparkSession.createDataFrame([], "doc_id long, quality int")), mixing.mixture, line_dedup.dedup_lines, license_scan.scan_licenses,
    exact_dedup.exact_groups, language_id.identify, secret_scan.scan_secrets, packing.pack_documents, token_counts.token_counts, simhash_dedup.near_duplicate_components,
])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("run", [
    lambda d: quality_rules.quality_verdicts(d, d.sparkSession.createDataFrame([(1, 1)], "doc_id long, quality int")), mixing.mixture, line_dedup.dedup_lines, license_scan.scan_licenses,
    exact_dedup.exact_groups, language_id.identify, secret_scan.scan_secrets, packing.pack_documents, simhash_dedup.near_duplicate_components,
])
def test_nulls_everywhere(spark, run):
    docs = spark.createDataFrame([(None,) * 8, (None,) * 8, (1, "a b c", None, None, None, None, None, None)] + [(2, "x y", "en", "src", 1, "", 1, "")] * 3, SCHEMA)
    assert len(run(docs).collect()) == 6
