"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from leafwork.llm.licenses import PHRASES, TEMPLATES, templates_of

_SPACE = r"[\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"list_filter(regexp_split_to_array({_LOWER}, '{_SPACE}'), lambda x: x <> '')"
_URL = "coalesce(url, '')"
_HOST = (
    f"translate(regexp_extract({_URL}, '^.*?://([^/?#]*)', 1, 's'), "
    "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)
_PATH = f"regexp_extract({_URL}, '^.*?://[^/?#]*([^?#]*)', 1, 's')"
_TOKENS = r"(?:^|[^a-z0-9])(?:casino|porn|xxx|viagra|torrent|warez)(?:[^a-z0-9]|$)"

EXACT = f"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""

NGRAMS = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1) + 1),
         lambda i: array_to_string(w[i:i + least(len(w), 4) - 1], ' '))) AS g
  FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * m >= 85 * (x.n + y.n - m)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id
"""

SEARCH = f"""
WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents),
size AS (SELECT count(*) AS docs, sum(len(w)) / count(*) AS average FROM t),
tf AS (
  SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, unnest(w) AS g FROM t) GROUP BY doc_id, g),
df AS (SELECT g, ln(1 + (any_value(docs) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, size GROUP BY g),
hit AS (
  SELECT q.doc_id AS query_id, d.doc_id,
         round(sum(idf * (d.n * 2.2 / (d.n + 1.2 * (0.25 + 0.75 * len(t.w) / average)))), 6) AS score
  FROM tf q JOIN df USING (g) JOIN tf d ON d.g = q.g JOIN t ON t.doc_id = d.doc_id CROSS JOIN size
  WHERE q.doc_id % 20 = 0 GROUP BY q.doc_id, d.doc_id)
SELECT query_id, doc_id, score, CAST(rank AS BIGINT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hit)
WHERE rank <= 10
"""

URLS = f"""
WITH u AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
v AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(lower(host || path), '{_TOKENS}') THEN 'block' ELSE 'allow' END AS verdict
FROM v
"""

ARCHIVE = """
WITH h AS (SELECT page_id, coalesce(html, '') AS html, upper(sha1(coalesce(html, ''))) AS hex FROM pages),
b AS (
  SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, hex,
         array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789ABCDEF', hex[i]) - 1), 4, '0')), '') AS bits
  FROM h),
d AS (
  SELECT page_id, payload_bytes, min(page_id) OVER (PARTITION BY hex) AS first,
         array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
           CAST(list_sum(list_transform(range(1, 6), lambda k: CAST(bits[i * 5 + k] AS INTEGER) * (1 << (5 - k)))) AS INTEGER) + 1]), '')
           AS payload_digest
  FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

#: CRC-32 from a table of 256 entries; the cheapest edits row by row, state by state.
REPAIR = """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
         lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS name
  FROM conversations),
hit AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(
         list_prepend(4294967295, list_transform(name, lambda x: CAST(ascii(x) AS BIGINT))),
         lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1]))) % 20 AS fault
  FROM named, crc),
hurt AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hit),
numbered AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') AS key,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
         regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS last
  FROM hurt),
judged AS (
  SELECT *, left(role, 1) AS initial, last = '' AS blank,
         last <> '' AND i > min(i) OVER (PARTITION BY key, role, text) AS again,
         lag(left(role, 1)) OVER (PARTITION BY key ORDER BY i) AS before
  FROM numbered),
faults AS (SELECT *, NOT blank AND NOT again AND last NOT IN ('.', '!', '?') AS cut FROM judged),
counts AS (
  SELECT key, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, count(*) FILTER (cut) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY key),
closure(p, q, more, ins) AS (VALUES (0, 0, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 1, 0, ''), (1, 2, 3, 'I'),
  (1, 3, 6, 'II'), (2, 2, 0, ''), (2, 3, 3, 'I'), (3, 3, 0, ''), (3, 2, 3, 'I')),
steps(p, letter, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
edits AS (
  SELECT key, i, p, q, 'K' AS edit, CASE WHEN cut THEN 3 ELSE 0 END AS price
  FROM faults JOIN steps ON letter = initial WHERE NOT blank AND NOT again
  UNION ALL SELECT key, i, p, q, 'R', CASE WHEN cut THEN 6 ELSE 3 END
  FROM faults, steps WHERE letter <> 's' AND NOT blank AND NOT again
  UNION ALL SELECT key, i, p, p, 'D', 4 FROM faults, (SELECT unnest(range(4)) AS p)),
walk(key, i, state, best) AS (
  SELECT key, CAST(0 AS BIGINT), q, {'cost': more, 'audit': ins} FROM counts, closure WHERE p = 0
  UNION ALL
  SELECT w.key, w.i + 1, c.q, min({'cost': w.best.cost + e.price + c.more, 'audit': w.best.audit || e.edit || c.ins})
  FROM walk w JOIN edits e ON e.key = w.key AND e.i = w.i + 1 AND e.p = w.state JOIN closure c ON c.p = e.q
  GROUP BY w.key, w.i, c.q),
cheapest AS (
  SELECT key, min(best) AS best FROM walk JOIN counts USING (key) WHERE i = n AND state IN (0, 3) GROUP BY key),
letters AS (
  SELECT key, unnest(string_split(best.audit, '')) AS edit, unnest(range(length(best.audit))) AS pos,
         (length(best.audit) - length(replace(best.audit, 'D', ''))) AS gone, length(best.audit) AS total
  FROM cheapest WHERE best.audit <> ''),
placed AS (
  SELECT *, sum(CAST(edit <> 'I' AS INT)) OVER (PARTITION BY key ORDER BY pos) AS i,
         sum(CAST(edit <> 'D' AS INT)) OVER (PARTITION BY key ORDER BY pos) - 1 - (total - gone) % 2 AS spot
  FROM letters),
turns AS (
  SELECT p.key, pos, CASE WHEN edit = 'K' THEN role WHEN spot % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' ||
         CASE WHEN edit = 'I' THEN '' ELSE text END AS line
  FROM placed p LEFT JOIN faults f ON f.key = p.key AND f.i = p.i WHERE edit <> 'D'),
hashes AS (SELECT key, sha256(string_agg(line, chr(10) ORDER BY pos)) AS sha FROM turns GROUP BY key),
ids AS (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS key FROM conversations)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
       coalesce(best.audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM ids LEFT JOIN counts USING (key) LEFT JOIN cheapest USING (key) LEFT JOIN hashes USING (key)
"""

_TERMS = "list_filter(string_split_regex(%s, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


def _listed(words) -> str:
    return "[" + ", ".join(f"'{w.decode()}'" for w in words) + "]"


_PHRASES = ", ".join(f"('{label}', string_split('{text}', ' '))" for text, label in PHRASES.items())
_TEMPLATES = ", ".join(
    f"({k}, '{t.label}', {t.block // 2}, {t.needed}, {_listed(sorted(t.distinct))})" for k, t in enumerate(templates_of(TEMPLATES))
)

#: Every block against every template, by counting shared words; no filters.
LICENSES = f"""
WITH d AS (SELECT doc_id, {_TERMS % _LOWER} AS w FROM documents),
phrases(label, p) AS (VALUES {_PHRASES}),
templates(k, label, step, needed, t) AS (VALUES {_TEMPLATES}),
words AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
places AS (
  SELECT doc_id, label, pos - j AS pos
  FROM words JOIN (SELECT label, len(p) AS size, unnest(p) AS word, unnest(range(len(p))) AS j FROM phrases) USING (word)
  GROUP BY doc_id, label, pos - j HAVING count(*) = any_value(size)),
shared AS (
  SELECT doc_id, n, k, word, unnest([pos // step, pos // step - 1]) AS block
  FROM words JOIN (SELECT k, step, unnest(t) AS word FROM templates) USING (word)),
blocks AS (
  SELECT doc_id, k, label, count(DISTINCT word) / len(any_value(t)) AS share
  FROM shared JOIN templates USING (k) WHERE block = 0 OR block > 0 AND block * step + step < n
  GROUP BY doc_id, k, label, block HAVING count(DISTINCT word) >= any_value(needed)),
base AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
every AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM (SELECT doc_id, label, 1.0 AS share FROM places UNION ALL SELECT doc_id, label, share FROM blocks) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id)
"""

ORACLES = {
    "op2_exact_dedup": EXACT,
    "op3_bm25_search": SEARCH,
    "op4_ngram_join": NGRAMS,
    "op7_url_rules": URLS,
    "op9_warc": ARCHIVE,
    "op11_conversation_repair": REPAIR,
    "op13_license_scan": LICENSES,
}
