"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from rowloom.llm.sharding import ROW_BYTES, SHARDS
from rowloom.llm.urls import ALIAS_HOST, ALIAS_PATH, RULES, TRACKING

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_SPACED = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

DECONTAMINATE = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS w FROM benchmark),
wanted AS (
  SELECT DISTINCT item, n, array_to_string(w[a + 1 : a + n], ' ') AS x
  FROM (SELECT item, w, least(len(w), 13) AS n, unnest(range(0, greatest(len(w) - 12, 1))) AS a FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM wanted),
places AS (
  SELECT doc_id, n, a, array_to_string(w[a + 1 : a + n], ' ') AS x
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS a FROM docs, sizes WHERE len(w) >= n)),
hits AS (SELECT p.doc_id, p.a, p.n, t.item FROM places p JOIN wanted t ON p.n = t.n AND p.x = t.x),
words AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + n)) AS i FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)"""

# CRC-32 by the reflected polynomial, a byte at a time over a table of 256 remainders.
_POLYNOMIAL = "3988292384"
_STEP = f"CASE WHEN c & 1 = 1 THEN xor(c >> 1, {_POLYNOMIAL}) ELSE c >> 1 END"
BYTE_SHARDS = f"""
WITH RECURSIVE remainders(b, k, c) AS (
  SELECT b, 0, CAST(b AS BIGINT) FROM (SELECT unnest(range(0, 256)) AS b)
  UNION ALL SELECT b, k + 1, {_STEP} FROM remainders WHERE k < 8),
remainder_list AS (SELECT list(c ORDER BY b) AS t FROM remainders WHERE k = 8),
digits AS (SELECT doc_id, hex(coalesce(text, '')) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
bytes AS (SELECT doc_id, n, list_transform(regexp_extract_all(h, '..'), lambda p: CAST('0x' || p AS BIGINT)) AS bs FROM digits),
sized AS (
  SELECT doc_id, CAST(n + {ROW_BYTES} AS BIGINT) AS size,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bs), lambda c, b: xor(t[CAST(xor(c, b) & 255 AS INTEGER) + 1], c >> 8)), 4294967295) AS text_crc32
  FROM bytes, remainder_list),
summed AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total
  FROM sized),
placed AS (SELECT *, CAST(least((before * 2 + size) * {SHARDS} // (2 * total), {SHARDS - 1}) AS INTEGER) AS shard FROM summed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed"""

_fits = {r: f"((host = '{r[0]}' OR ends_with(host, '.{r[0]}')) AND starts_with(path, '{r[1]}'))" for r in RULES}
_ordered = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
_own = f"CASE {' '.join(f"WHEN {_fits[r]} THEN '{r[2]}'" for r in _ordered)} END"
#: For pages without canonical links and refreshes, which the given tables don't have: classes are then the urls of one
#: canonical form, with that form. Tests cover links.
URL_FILTER = rf"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(coalesce(url, ''), '(?s)^[^?#]*\?([^#]*)', 1) AS query FROM pages),
ruled AS (
  SELECT *, CASE {' '.join(f"WHEN {_fits[r]} THEN '{r[0]}{r[1]}'" for r in _ordered)} END AS rule, {_own} AS own FROM parts),
formed AS (
  SELECT *, regexp_replace(host, '{ALIAS_HOST}', '') AS h, regexp_replace(path, '{ALIAS_PATH}', '') AS p,
    list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '{TRACKING}')) AS q FROM ruled),
classed AS (SELECT *, CASE WHEN host <> '' THEN h || p || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS class FROM formed),
members AS (
  SELECT class, own FROM classed WHERE class IS NOT NULL
  UNION ALL SELECT class, {_own} FROM (SELECT DISTINCT class, h AS host, p AS path FROM classed WHERE class IS NOT NULL)),
spread AS (SELECT class, CASE WHEN bool_or(own = 'allow') THEN 'allow' WHEN bool_or(own = 'block') THEN 'block' END AS spread FROM members GROUP BY class)
SELECT page_id, host, path, rule, coalesce(own, spread, 'allow') AS verdict,
  CASE WHEN own IS NOT NULL THEN 'rule' WHEN spread IS NOT NULL THEN 'alias' ELSE 'default' END AS via
FROM classed LEFT JOIN spread USING (class)"""

REPEATED_PASSAGES = f"""
WITH docs AS (SELECT doc_id, {_SPACED} AS w FROM documents),
windows AS (
  SELECT doc_id, a, array_to_string(w[a + 1 : a + 20], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - 19)) AS a FROM docs WHERE len(w) >= 20)),
late AS (SELECT doc_id, a FROM windows QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, a) > 1),
gone AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(a, a + 20)) AS i FROM late) GROUP BY doc_id),
flat AS (
  SELECT doc_id, i, word FROM (SELECT doc_id, unnest(range(0, len(w))) AS i, unnest(w) AS word FROM docs)),
kept AS (
  SELECT f.doc_id, string_agg(f.word, ' ' ORDER BY f.i) AS kept
  FROM flat f ANTI JOIN (SELECT doc_id, unnest(gone) AS i FROM gone) g ON f.doc_id = g.doc_id AND f.i = g.i GROUP BY f.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""

ORACLES = {
    "op1_decontaminate": DECONTAMINATE,
    "op5_byte_shards": BYTE_SHARDS,
    "op6_url_filter": URL_FILTER,
    "op9_repeated_passages": REPEATED_PASSAGES,
}
