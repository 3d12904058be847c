"""DuckDB forms of the text functions and of the row, group and line tables, for the queries' oracles."""

from __future__ import annotations

from rowloom.functions import lexicon as lx

SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(values: list[str]) -> str:
    return "(" + ", ".join(q(v) for v in dict.fromkeys(values)) + ")"


def n(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), {q(SPACE)}, ' ', 'g'))"


def t(c: str) -> str:
    a = f"regexp_replace({n(c)}, {q(lx.NO_SPACE_BEFORE)}, '\\1', 'g')"
    return f"trim(regexp_replace(regexp_replace({a}, {q(lx.NO_SPACE_AFTER)}, '\\1', 'g'), ' {{2,}}', ' ', 'g'))"


def polished(c: str) -> str:
    out = t(c)
    for pattern, _ in lx.POLISH:
        out = f"regexp_replace({out}, {q(pattern)}, '\\1', 'g')"
    return out


def count(c: str) -> str:
    """Words of normalized text."""
    return f"(CASE WHEN {c} = '' THEN 0 ELSE len(string_split({c}, ' ')) END)"


def reading(c: str) -> str:
    return f"length(regexp_replace(coalesce({c}, ''), {q(SPACE)}, '', 'g'))"


def has(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {q(pattern)})"


def capitals(c: str, least: int) -> str:
    letters = f"regexp_replace({c}, '[^A-Za-z]', '', 'g')"
    return f"(length({letters}) >= {least} AND {letters} = upper({letters}))"


def header(c: str) -> str:
    return f"({has(c, lx.HEADER)} OR (length({c}) > 40 AND {c} = upper({c})))"


def meta(c: str) -> str:
    return f"({has(c, lx.BRACKETED)} OR {has(c, lx.URL)} OR {has(c, lx.CREDIT)} OR ({capitals(c, 4)} AND {count(c)} <= 4))"


def date(c: str) -> str:
    return f"({has(c, '(?i)(' + lx.MONTHS + ')(?:[^A-Za-z0-9_]|$)')} OR {has(c, '(?:^|[^A-Za-z0-9_])[0-9]{4}(?:[^A-Za-z0-9_]|$)')})"


def title(c: str) -> str:
    return f"({has(c, lx.TITLE)} OR {capitals(c, 8)})"


def row_type(c: str) -> str:
    return f"(CASE WHEN {meta(c)} THEN 'source' WHEN {date(c)} THEN 'date' WHEN {title(c)} THEN 'title' ELSE 'normal' END)"


def comparable(c: str) -> str:
    return f"lower(trim(regexp_replace(coalesce({c}, ''), {q(lx.IGNORED_IN_TOKENS)}, '', 'g')))"


def adjective(c: str) -> str:
    return f"({c} <> '' AND ({c} IN {words(lx.ADJECTIVES)} OR {has(c, lx.ADJECTIVE_ENDS)}))"


def content(c: str) -> str:
    return f"({c} <> '' AND {c} NOT IN {words(lx.CONNECTORS + lx.AUXILIARIES + lx.VERB_PREFIXES)} AND {has(c, '[؀-ۿA-Za-z]')})"


def rows_cte(target_script: bool = False, kinds: str = "SELECT doc_id, text FROM documents") -> str:
    target = "coalesce(b.source_text, '')"
    if target_script:
        target = f"translate(lower({target}), 'abcdefghijklmnopqrstuvwxyz', 'ابپتثجچحخدذرزسشصضطظعغفقکگل')"
    return f"""
doc_words AS (SELECT doc_id, list_filter(string_split({n('text')}, ' '), lambda x: x <> '') AS w FROM ({kinds})),
cut_rows AS (
  SELECT doc_id, CAST(k AS INTEGER) AS idx, array_to_string(w[6 * k + 1 : 6 * k + 6], ' ') AS source_text
  FROM (SELECT doc_id, w, unnest(range(0, (len(w) + 5) // 6)) AS k FROM doc_words)),
doc_rows AS (
  SELECT a.doc_id, a.idx, a.idx + 1 AS row_number, a.source_text, {target} AS target_text
  FROM cut_rows a LEFT JOIN cut_rows b
    ON b.doc_id = a.doc_id + 1 AND b.idx = a.idx - (CASE WHEN a.idx % 7 = 1 THEN 1 ELSE 0 END))"""


def kinds_cte(table: str = "doc_rows") -> str:
    return f"""
spaced AS (SELECT *, {n('source_text')} AS s, {n('target_text')} AS tn, {t('target_text')} AS t FROM {table}),
started AS (
  SELECT *, coalesce(min(CASE WHEN {has('tn', lx.TARGET_SCRIPT)} AND s <> '' THEN idx END) OVER (PARTITION BY doc_id), 0) AS start_idx
  FROM spaced),
kinds AS (
  SELECT doc_id, idx, row_number, source_text, target_text, s, t, {row_type('s')} AS row_type, {has('s', lx.SENTENCE_END)} AS ends,
    CASE WHEN idx < start_idx THEN 'skip' WHEN s = '' AND tn = '' THEN 'blank' WHEN tn = '' THEN 'locked'
      WHEN {header('s')} OR s LIKE '%:' THEN 'locked' WHEN {meta('s')} THEN 'meta' ELSE 'subtitle' END AS kind
  FROM started)"""


GROUPS = """
marked AS (
  SELECT *, lag(kind) OVER d AS kind_before, lag(ends) OVER d AS ended FROM kinds WINDOW d AS (PARTITION BY doc_id ORDER BY idx)),
grouped AS (
  SELECT * EXCLUDE (kind_before, ended),
    CAST(sum(CASE WHEN kind_before IS NULL OR kind <> 'subtitle' OR kind_before <> 'subtitle' OR ended THEN 1 ELSE 0 END)
      OVER (PARTITION BY doc_id ORDER BY idx) AS INTEGER) AS group_id
  FROM marked)"""

LINES = """
lines AS (
  SELECT doc_id, group_id, idx, row_type, t AS line, length(t) AS chars, len(string_split(t, ' ')) AS words
  FROM grouped WHERE kind = 'subtitle' AND t <> '')"""

STATISTICS = """
statistics AS (
  SELECT row_type, count(*) AS line_count, max(chars) AS char_max, max(words) AS word_max,
    quantile_cont(chars, [0.25, 0.5, 0.9, 0.95]) AS c, quantile_cont(words, [0.25, 0.5, 0.9, 0.95]) AS w
  FROM lines GROUP BY GROUPING SETS ((), (row_type)))"""


def _up(c: str) -> str:
    return f"CAST(floor({c} + 0.5) AS INTEGER)"


LIMITS = f"""
limits AS (
  SELECT row_type, line_count,
    greatest(8, {_up('c[1]')}) AS preferred_char_min, greatest(12, {_up('c[2]')}) AS preferred_char_target,
    greatest(24, {_up('c[3]')}) AS preferred_char_max, greatest(30, {_up('c[4]')}) AS soft_char_max,
    least(60, greatest(45, {_up('greatest(c[4] + 2, char_max)')})) AS hard_char_max,
    greatest(2, {_up('w[2]')}) AS preferred_word_target, greatest(4, {_up('w[3]')}) AS preferred_word_max,
    least(16, greatest(9, {_up('greatest(w[3] + 1, word_max)')})) AS hard_word_max,
    CAST(char_max AS INTEGER) AS observed_char_max, CAST(word_max AS INTEGER) AS observed_word_max
  FROM statistics)"""

RUNS = """
run_marks AS (
  SELECT *, CASE WHEN lag(t) OVER g IS NULL OR lag(t) OVER g <> t THEN 1 ELSE 0 END AS new,
    coalesce(row_type = 'title' AND lead(row_type) OVER g = 'date', false) AS pair
  FROM grouped WHERE kind = 'subtitle' WINDOW g AS (PARTITION BY doc_id, group_id ORDER BY idx)),
run_ids AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, group_id ORDER BY idx) AS run FROM run_marks),
runs AS (
  SELECT doc_id, group_id, CAST(min(idx) AS INTEGER) AS idx, count(*) AS run_length, arg_min(pair, idx) AS title_date
  FROM run_ids WHERE t <> '' GROUP BY doc_id, group_id, run)"""


def base(target_script: bool = False) -> str:
    return f"WITH {rows_cte(target_script)},{kinds_cte()},{GROUPS}"


def _phrases(size: int) -> str:
    """Whether a fixed phrase of ``size`` words starts at a token."""
    following = ["c", *(f"lead(c, {k}) OVER l" for k in range(1, size))]
    return "coalesce(concat_ws(' ', " + ", ".join(following) + f") IN {words([p for p in lx.PHRASES if p.count(' ') == size - 1])}, false)"


def units_cte(texts: str) -> str:
    """``units`` of the (doc_id, idx, w) that ``texts`` selects: what may join two words is found for all words at once;
    then a walk along each text opens units, at a phrase or at a word that doesn't belong to the open unit."""
    clean = f"regexp_replace(word, {q(lx.IGNORED_IN_TOKENS)}, '', 'g')"
    return f"""
texts AS ({texts}),
text_words AS (SELECT doc_id, idx, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM texts),
tokens AS (SELECT *, {comparable('word')} AS c, {clean} AS bare, length(regexp_replace(word, '[^«"]', '', 'g')) AS marks FROM text_words),
classes AS (SELECT *, {adjective('c')} AS adj, {content('c')} AS con FROM tokens),
joints AS (
  SELECT doc_id, idx, pos, sum(marks) OVER l AS so_far,
    CASE WHEN con AND lead(adj) OVER l AND coalesce(lead(con, 2) OVER l OR lead(adj, 2) OVER l, false) OR {_phrases(3)} THEN 3
      WHEN (con OR adj) AND lead(adj) OVER l OR {_phrases(2)} THEN 2 WHEN {_phrases(1)} THEN 1 ELSE 0 END AS phrase,
    coalesce((regexp_matches(lag(bare) OVER l, '[A-Za-z]') AND regexp_matches(bare, '[A-Za-z]'))
      OR (length(bare) <= 4 AND regexp_matches(lag(bare) OVER l, '[0-9]')) OR right(lag(bare) OVER l, 1) IN ('\u0650', '\u200c')
      OR bare IN {words(lx.AUXILIARIES)} OR starts_with(bare, 'می\u200c') OR starts_with(bare, 'نمی\u200c'), false) AS sticks
  FROM classes WINDOW l AS (PARTITION BY doc_id, idx ORDER BY pos)),
joint_lists AS (SELECT doc_id, idx, list(phrase ORDER BY pos) AS phrase, list(sticks ORDER BY pos) AS sticks, list(so_far ORDER BY pos) AS so_far FROM joints GROUP BY doc_id, idx),
walk AS (
  SELECT doc_id, idx, w, phrase, sticks, so_far, 1 AS place, CAST(NULL AS INTEGER) AS began, CAST([] AS INTEGER[]) AS starts FROM texts JOIN joint_lists USING (doc_id, idx)
  UNION ALL
  SELECT doc_id, idx, w, phrase, sticks, so_far, CAST(place + CASE WHEN on_it THEN 1 ELSE greatest(1, phrase[place]) END AS INTEGER),
    CASE WHEN on_it THEN began WHEN phrase[place] = 0 THEN place END, CASE WHEN on_it THEN starts ELSE list_append(starts, place) END
  FROM (SELECT *, began IS NOT NULL AND (sticks[place] OR (so_far[place - 1] - coalesce(so_far[began - 1], 0)) % 2 = 1) AS on_it FROM walk WHERE place <= len(w))),
units AS (
  SELECT doc_id, idx, CAST(len(starts) AS INTEGER) AS n_units,
    list_transform(range(1, len(starts) + 1), lambda i: array_to_string(w[starts[i] : coalesce(starts[i + 1] - 1, len(w))], ' ')) AS units
  FROM walk WHERE place > len(w))"""
