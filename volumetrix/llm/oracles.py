"""DuckDB SQL of the operators that SQL can express, written apart from their DataFrame forms.

Fixed values (patterns, sentences, cutoffs) come from the operators; the steps do not. Look-arounds
and back references, which this SQL lacks, are replaced by plain steps that match the same strings.
White space is written as a class of its six characters.
"""

from __future__ import annotations

from . import license_scan, quality_rules, secret_scan

SPACE = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '"
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"[^\x20\x09-\x0D]+"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


LINE_DEDUP = f"""
WITH cut AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM cut
), keyed AS (
  SELECT doc_id, pos, line, {LOWER.format(f"trim(line, {SPACE})")} AS k FROM line
), often AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT d.doc_id, d.pos, d.line, (o.k IS NOT NULL AND d.doc_id IS DISTINCT FROM o.last) AS lost FROM keyed d LEFT JOIN often o USING (k)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(lost::INT) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def quality_rules_sql() -> str:
    """Counts by windows over unnested words and lines; levels by the binomial sum, a row per term."""
    q = quality_rules
    rules = {
        "symbols_per_word": "n_symbols / greatest(n_words, 1)", "repeat_share": "n_repeat_words / greatest(n_words, 1)", "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
        "upper_share": "n_upper / greatest(n_upper + n_lower, 1)", "marks_per_word": "n_marks / greatest(n_words, 1)", "word_length": "word_chars / greatest(n_words, 1)",
    }
    # cutoffs by level: a rule whose cutoffs have run out stays at the tightest
    above = lambda k: " OR ".join(f"({x})::DOUBLE > {q.cutoffs_at(k)[r]!r}" for r, x in rules.items())
    level = "CASE " + " ".join(f"WHEN {above(k)} THEN {k}" for k in range(1, q.LEVELS + 1)) + f" ELSE {q.NEVER} END"
    rate = f"{q.LIMIT!r}::DOUBLE"
    only = lambda cls: f"length(regexp_replace(t, '[^{cls}]', '', 'g'))"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT r, regexp_extract_all(t, '{WORD}') AS ws FROM d)
), triple AS (
  SELECT r, pos, w, lead(w) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY r ORDER BY pos)
), twice AS (
  SELECT r, pos FROM (SELECT r, pos, count(*) OVER (PARTITION BY r, w, w1, w2) AS n FROM triple WHERE w2 IS NOT NULL) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT pos + k) AS n FROM twice, (VALUES (0), (1), (2)) AS step(k) GROUP BY r
), words AS (
  SELECT r, count(*) AS n, sum(length(w))::BIGINT AS chars FROM w GROUP BY r
), lines AS (
  SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '{WORD}') GROUP BY r
), m AS (
  SELECT r, doc_id, stratum, coalesce(words.n, 0) AS n_words, coalesce(words.chars, 0) AS word_chars, coalesce(covered.n, 0) AS n_repeat_words,
         coalesce(lines.n, 0) AS n_lines, coalesce(lines.dup, 0) AS n_dup_lines, {only('#*$%&|<>')} AS n_symbols,
         {only('A-Z')} AS n_upper, {only('a-z')} AS n_lower, {only('!-/:-@[-`{-~')} AS n_marks
  FROM d LEFT JOIN words USING (r) LEFT JOIN covered USING (r) LEFT JOIN lines USING (r)
), b AS (
  SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, {level} AS level FROM m
), label AS (
  SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), held AS (
  SELECT doc_id, min(stratum) AS stratum, min(level) AS level, any_value(good) AS good FROM b JOIN label USING (doc_id) WHERE NOT base_failed GROUP BY doc_id
), tried AS (
  SELECT stratum, k, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE good AND level <= k) AS lost, count(*) FILTER (WHERE NOT good AND level <= k) AS caught
  FROM held, range(1, {q.LEVELS + 1}) AS ladder(k) GROUP BY ALL
), term AS (
  SELECT stratum, k, n, unnest(range(0, lost + 1)) AS i FROM tried WHERE lost < n * {rate} + 1 AND lost < n
), tail AS (
  SELECT stratum, k, sum(exp(lgamma((n + 1)::DOUBLE) - lgamma((i + 1)::DOUBLE) - lgamma((n - i + 1)::DOUBLE) + i * ln({rate}) + (n - i) * ln(1 - {rate}))) AS p FROM term GROUP BY ALL
), passed AS (
  SELECT t.*, coalesce(p <= {q.ERROR!r}::DOUBLE / (SELECT greatest(1, count(DISTINCT stratum)) FROM tried WHERE n > 0), false) AS ok FROM tried t LEFT JOIN tail USING (stratum, k)
), valid AS (
  SELECT *, bool_and(ok) OVER (PARTITION BY stratum ORDER BY k) AS certified FROM passed
), chosen AS (
  SELECT stratum, arg_max(k, (caught - {q.WORTH} * lost) * 1000 - k) AS chosen FROM valid WHERE certified AND caught > {q.WORTH} * lost GROUP BY ALL
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND level > coalesce(chosen, 0) AS kept FROM b LEFT JOIN chosen USING (stratum)
"""


def license_scan_sql() -> str:
    """A step per rule over the lines of identifiers, each identifier between two blanks of its own.

    Wraps are marked by a character of their own, so that a paragraph's sentences can be read joined
    and line by line side by side.
    """
    ls = license_scan
    known = ", ".join(f"({quoted(s)}, {quoted(n)})" for s, n in ls.table().items())
    plain = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' ')"
    tally = "count(*) AS n, count(id) AS hits, string_agg(' ' || coalesce(id, '?') || ' ', '' ORDER BY {0}) AS line, coalesce(string_agg(id, ',' ORDER BY {0}), '') AS ids"
    cut = lambda text: rf"string_split_regex(regexp_replace({text}, '([.!?])[ \t]+', '\1' || chr(1), 'g'), '\x01|[\r\n]+')"
    reading = lambda name, text: rf"""
{name} AS (
  SELECT r, {tally.format('pos')} FROM (SELECT r, unnest(parts) AS s, generate_subscripts(parts, 1) AS pos FROM (SELECT r, {cut(text)} AS parts FROM cued)) x
  LEFT JOIN known ON known.s = {plain.format('x.s')} GROUP BY r
)"""  # noqa: E731
    # a wrapped line's end has no line end on either side; its neighbours stay
    mark = lambda t: rf"regexp_replace({t}, '(^|[^\r\n])\r?\n([^\r\n]|$)', '\1' || chr(2) || '\2', 'g')"
    steps, at = [], "rule_0"
    for k, (name, ids) in enumerate(ls.RULES, 1):
        pattern = quoted(" " + (r"  (?:\?  ){0,%d}" % ls.GAP).join(ids) + " ")
        steps.append(f"rule_{k} AS (SELECT r, n, ids, regexp_replace(line, {pattern}, ' - ', 'g') AS line, CASE WHEN regexp_matches(line, {pattern}) AND NOT list_contains(names, {quoted(name)}) THEN list_append(names, {quoted(name)}) ELSE names END AS names FROM {at})")
        at = f"rule_{k}"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
cued AS MATERIALIZED (SELECT r, t, {mark(mark('t'))} AS marked FROM d WHERE regexp_matches(t, {quoted(ls.CUES)})),
known(s, id) AS (VALUES {known}),
{reading("lines", "t")},
{reading("joined", "replace(marked, chr(2), ' ')")},
one AS MATERIALIZED (
  SELECT r, j.hits > l.hits AS more, greatest(j.hits, l.hits) AS hits, l.hits > 0 AND j.hits > 0 AND l.ids <> j.ids AS differ,
         CASE WHEN j.hits > l.hits THEN j.n ELSE l.n END AS n, CASE WHEN j.hits > l.hits THEN j.ids ELSE l.ids END AS ids, CASE WHEN j.hits > l.hits THEN j.line ELSE l.line END AS line
  FROM lines l JOIN joined j USING (r)
),
piece AS (
  SELECT r, more, unnest(parts) AS p, generate_subscripts(parts, 1) AS para
  FROM (SELECT r, more, string_split_regex(regexp_replace(marked, '([.!?])[ \t\x02]+', '\1' || chr(1), 'g'), '\x01|[\r\n]+') AS parts FROM cued JOIN one USING (r) WHERE differ)
),
piece_line AS (
  SELECT r, more, para, pos, whole, known.id FROM (
    SELECT r, more, para, known.id AS whole, unnest(string_split(p, chr(2))) AS s, generate_subscripts(string_split(p, chr(2)), 1) AS pos FROM piece LEFT JOIN known ON known.s = {plain.format("replace(p, chr(2), ' ')")}
  ) x LEFT JOIN known ON known.s = {plain.format('x.s')}
),
both_row AS (
  SELECT r, para, pos, CASE WHEN apart THEN id ELSE whole END AS id FROM (SELECT *, whole IS NULL AND (NOT more OR count(id) OVER (PARTITION BY r, para) > 0) AS apart FROM piece_line) WHERE apart OR pos = 1
),
both_readings AS (SELECT r, {tally.format('para, pos')} FROM both_row GROUP BY r),
rule_0 AS (
  SELECT r, CASE WHEN b.hits > one.hits THEN b.n ELSE one.n END AS n, CASE WHEN b.hits > one.hits THEN b.ids ELSE one.ids END AS ids, CASE WHEN b.hits > one.hits THEN b.line ELSE one.line END AS line, []::VARCHAR[] AS names
  FROM one LEFT JOIN both_readings b USING (r)
),
{", ".join(steps)}
SELECT doc_id, coalesce(n, len({cut('d.t')})) AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(array_to_string(names, ','), '') AS licenses, names[1] AS license
FROM d LEFT JOIN {at} USING (r)
"""


def secret_scan_sql() -> str:
    """Spans by running sums over the parts between matches; every window's entropy counted anew."""
    ss = secret_scan
    kinds = list(ss.KINDS)
    classes = ss.CLASSES | ss.NARROW

    def found(kind: str, pattern: str, group: int, least: int) -> str:
        p = quoted(pattern)
        return rf"""
SELECT r, {kinds.index(kind)} AS rank, {quoted(kind)} AS kind, value, first, first + length(value) AS last FROM (
  SELECT r, value, part, (sum(length(gap)) OVER o + sum(length(value)) OVER o - length(value))::BIGINT AS first FROM (
    SELECT r, unnest(whole) AS value, unnest(parts) AS part, unnest(gaps[:len(whole)]) AS gap, generate_subscripts(whole, 1) AS pos
    FROM (SELECT r, regexp_extract_all(t, {p}, 0) AS whole, regexp_extract_all(t, {p}, {group}) AS parts, string_split_regex(t, {p}) AS gaps FROM d WHERE regexp_matches(t, {p}))
  ) WINDOW o AS (PARTITION BY r ORDER BY pos)
) WHERE length(part) >= {least}"""

    # candidates with conditions on what stands beside them are whole runs of those characters
    runs, mixed = "[0-9A-Za-z]+", "[A-Za-z0-9+/_-]+={0,2}"
    patterns = {"entropy_base64": classes["entropy_base64"][0], "entropy_hex": runs, "entropy_lower": runs, "entropy_upper": runs, "entropy_mixed": mixed}
    whole = {
        "entropy_base64": "true", "entropy_hex": "regexp_full_match(value, '[0-9a-fA-F]{20,}')", "entropy_lower": "regexp_full_match(value, '[0-9a-z]{20,}')", "entropy_upper": "regexp_full_match(value, '[0-9A-Z]{20,}')",
        "entropy_mixed": f"length(rtrim(value, '=')) >= 20 AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]') AND NOT regexp_matches(value, {quoted(ss.MIXED_PATH.replace('++', '+'))})",
    }
    candidates = " UNION ALL ".join(f"SELECT * FROM ({found(k, p, 0, 20)}) WHERE {whole[k]}" for k, p in patterns.items())
    plain = [x.replace("++", "+") for x in ss.ALLOWED if "\\1" not in x]
    unit = r"len(list_filter(range(1, 9), lambda u: length(value) % u = 0 AND length(value) > u AND value = repeat(left(value, u), length(value) // u))) > 0"
    allowed = " OR ".join([f"regexp_matches(value, {quoted(x)})" for x in plain] + [unit])
    least = "CASE kind " + " ".join(f"WHEN {quoted(k)} THEN {bits}" for k, (_, bits) in classes.items()) + " END"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({" UNION ALL ".join(found(k, *ss.BASE[k]) for k in ss.BASE)}),
candidate AS (SELECT row_number() OVER () AS c, * FROM ({candidates}) WHERE NOT ({allowed})),
char AS (SELECT c, o, unnest(string_split(substring(value, o + 1, {ss.WINDOW}), '')) AS ch FROM (SELECT c, value, unnest(range(0, length(value) - {ss.WINDOW} + 1)) AS o FROM candidate)),
tally AS (SELECT c, o, ch, count(*) AS n FROM char GROUP BY ALL),
entropy AS (SELECT c, o, -sum(n / {ss.WINDOW}.0::DOUBLE * log2(n / {ss.WINDOW}.0::DOUBLE)) AS bits FROM tally GROUP BY ALL),
peak AS (SELECT c, max(bits) AS bits FROM entropy GROUP BY c),
hot AS (SELECT r, rank, kind, first, last FROM candidate JOIN peak USING (c) WHERE bits >= {least}),
every AS (SELECT r, rank, kind, first, last FROM base UNION ALL SELECT * FROM hot),
seen AS (
  SELECT * FROM every x WHERE rank < {len(ss.BASE)} OR NOT EXISTS (
    SELECT 1 FROM every y WHERE y.r = x.r AND y.first <= x.first AND x.last <= y.last AND y.rank < CASE WHEN x.rank < {len(ss.BASE) + len(ss.CLASSES)} THEN {len(ss.BASE)} ELSE x.rank END
  )
),
written AS (
  SELECT r, string_agg(kind || ':' || first || ':' || last, ',' ORDER BY first, rank) AS spans, string_agg(kind || ':' || first || ':' || last, ',' ORDER BY first, rank) FILTER (WHERE rank < {len(ss.BASE)}) AS base_spans,
         {", ".join(f"count(*) FILTER (WHERE kind = {quoted(k)}) AS n_{k}" for k in ss.BASE)}
  FROM seen GROUP BY r
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in ss.BASE)}, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN written USING (r)
"""


ORACLES: dict[str, str] = {
    "op1_quality_rules": quality_rules_sql(),
    "op3_line_dedup": LINE_DEDUP,
    "op4_license_scan": license_scan_sql(),
    "op5_exact_dedup": EXACT_DEDUP,
    "op7_secret_scan": secret_scan_sql(),
}
