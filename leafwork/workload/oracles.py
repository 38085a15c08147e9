"""Check SQL for the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

from leafwork import constants as C
from leafwork.workload import inputs as I

NL = "chr(10)"
ORACLES: dict[str, str] = {}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return ", ".join(_quoted(v) for v in values)


WS = _quoted(C.WHITESPACE)


def _strip(x: str) -> str:
    return f"trim({x}, {WS})"


# --- words and counts ----------------------------------------------------------
def _words(text: str) -> str:
    runs = rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+')"
    return f"list_filter({runs}, lambda w: regexp_full_match(w, '[a-z]{{3,}}'))"


def _lines(text: str) -> str:
    newlines = f"(length({text}) - length(replace({text}, {NL}, '')))"
    tail = f"(CASE WHEN {text} = '' OR suffix({text}, {NL}) THEN 0 ELSE 1 END)"
    return f"CAST({newlines} + {tail} AS BIGINT)"


def _page_lines(text: str) -> str:
    marked = f"regexp_extract_all({text}, '(?m)^--- Page ')"
    return f"CAST(len({marked}) AS BIGINT)"


def _stats(text: str, tokens: str) -> str:
    lines = _lines(text)
    return f"""CAST(length({text}) AS BIGINT) AS total_chars,
 CAST(len({tokens}) AS BIGINT) AS total_words,
 {lines} AS total_lines,
 {_page_lines(text)} AS total_pages,
 CAST(printf('%.2f', len({tokens}) / greatest({lines}, 1)) AS DOUBLE) AS avg_words_per_line"""


def _language(tokens: str, compat: bool) -> str:
    scores = {}
    for lang, markers in C.LANGUAGE_MARKERS.items():
        kept = [m for m in markers if not (compat and m in C.STOP_WORDS)]
        found = " + ".join(
            f"(CASE WHEN list_contains({tokens}, {_quoted(m)}) THEN 1 ELSE 0 END)" for m in kept
        )
        scores[lang] = f"({found or '0'})"
    best = f"greatest({', '.join(scores.values())})"
    cases = " ".join(f"WHEN {s} = {best} THEN '{lang}'" for lang, s in scores.items())
    return f"CASE WHEN {best} = 0 THEN 'unknown' {cases} END"


def _top(source: str, key: str, tokens: str = "w") -> str:
    """Rows (key, top_words) for every row of ``source``."""
    return f"""(SELECT {key}, coalesce(string_agg(word, ' ' ORDER BY rk) FILTER (rk <= {C.TOP_WORDS}), '') AS top_words
 FROM (SELECT s.{key}, g.word, row_number() OVER (PARTITION BY s.{key} ORDER BY g.n DESC, g.fp) AS rk
  FROM {source} s LEFT JOIN (
   SELECT {key}, word, count(*) AS n, min(pos) AS fp
   FROM (SELECT {key}, unnest({tokens}) AS word, generate_subscripts({tokens}, 1) AS pos FROM {source})
   WHERE word NOT IN ({_list(C.STOP_WORDS)}) GROUP BY {key}, word) g USING ({key}))
 GROUP BY {key})"""


# --- jobs -------------------------------------------------------------------------
_J = "json_extract_string(j, '$.{0}') AS {0}"
_FIELDS = [
    "job_id", "document_type", "location_type", "s3_bucket", "s3_key", "s3_endpoint_url", "url",
    "ftp_host", "ftp_port", "ftp_path", "auth_type", "output_s3_bucket", "output_s3_key",
]
PARSED = f"""
WITH m AS (SELECT page_id, {I.MESSAGE} AS value FROM pages),
v AS (SELECT *, CASE WHEN json_valid(value) THEN value ELSE 'null' END AS j FROM m),
f AS (SELECT page_id, value, json_type(j) = 'OBJECT' AS is_object, json_exists(j, '$.ftp_port') AS has_port,
 {", ".join(_J.format(n) for n in _FIELDS)} FROM v),
e AS (SELECT *, CASE
 WHEN NOT is_object THEN 'message is not a JSON object'
 WHEN document_type IS NULL THEN 'document_type is required'
 WHEN document_type NOT IN ({_list(C.DOCUMENT_TYPES)}) THEN 'unknown document_type: ' || document_type
 WHEN location_type IS NULL THEN 'location_type is required'
 WHEN location_type NOT IN ({_list(C.LOCATION_TYPES)}) THEN 'unknown location_type: ' || location_type
 WHEN page_id % 40 = 37 THEN 'auth_token is not text'
 WHEN has_port AND (ftp_port IS NULL OR NOT regexp_full_match(ftp_port, '[+-]?[0-9]+')) THEN 'ftp_port is not an integer'
 END AS error FROM f),
parsed AS (SELECT page_id, coalesce(nullif(CASE WHEN page_id % 40 = 19 THEN 'm' || page_id ELSE job_id END, ''), substr(sha256(value), 1, 12)) AS job_id,
 document_type, location_type, s3_bucket, s3_key, s3_endpoint_url, url, ftp_host, ftp_path,
 output_s3_bucket, output_s3_key, coalesce(TRY_CAST(ftp_port AS BIGINT), 21) AS ftp_port,
 CASE WHEN error IS NULL THEN coalesce(auth_type, 'none') END AS auth_type,
 CASE WHEN error IS NOT NULL THEN replace(value, '["a","b"]', '"***"') END AS raw, error FROM e),
checked AS (SELECT * EXCLUDE (error), coalesce(error, CASE
 WHEN location_type = 'local' THEN 'LOCAL location requires a local_file_path'
 WHEN location_type = 's3' AND (coalesce(s3_bucket, '') = '' OR coalesce(s3_key, '') = '') THEN 's3_bucket and s3_key are required for S3 location'
 WHEN location_type = 'url' AND coalesce(url, '') = '' THEN 'url is required for URL location'
 WHEN location_type = 'ftp' AND (coalesce(ftp_host, '') = '' OR coalesce(ftp_path, '') = '') THEN 'ftp_host and ftp_path are required for FTP location'
 END) AS error FROM parsed)
"""


def _case(column: str, values: dict[str, str], default: str) -> str:
    arms = " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in values.items())
    return f"CASE {column} {arms} ELSE {default} END"


_FAMILY = _case("document_type", C.CONVERTER_FAMILIES, "NULL")
ORACLES["parse_jobs"] = PARSED + "SELECT * FROM parsed"
ORACLES["validate_jobs"] = PARSED + "SELECT page_id, job_id, location_type, error FROM checked"
ORACLES["jobs_stream"] = PARSED + (
    f"SELECT page_id, job_id, document_type, location_type, {_FAMILY} AS converter, "
    "error, error IS NOT NULL AS rejected FROM checked"
)
ORACLES["output_keys"] = PARSED + f"""
SELECT job_id, coalesce(nullif(output_s3_bucket, ''), '{I.OUTPUT_BUCKET}') AS output_bucket,
 coalesce(nullif(output_s3_key, ''), 'converted/' || job_id || '.txt') AS output_key,
 's3watch-' || replace(s3_key, '/', '-') AS watch_job_id,
 'converted/' || string_split(s3_key, '/')[-1] || '.txt' AS watch_key,
 'processed/' || string_split(s3_key, '/')[-1] AS archive_key,
 'pipeline/' || job_id || '/text.txt' AS flow_text_key,
 'pipeline/' || job_id || '/metadata.json' AS flow_metadata_key,
 'multi/' || job_id || '/full_text.txt' AS full_text_key,
 'multi/' || job_id || '/metadata.json' AS multi_metadata_key,
 'multi/' || job_id || '/pages/' || job_id || '/page_0001.txt' AS first_page_key
FROM parsed WHERE error IS NULL"""

# --- files --------------------------------------------------------------------------
_EXT = r"lower(regexp_extract({0}, '[^/.][^/]*(\.[^./]*)$', 1))"
FILES = f"""
WITH k AS (SELECT doc_id, text, strlen(text) AS size_bytes, {I.FILE_KEY} AS key FROM documents),
typed AS (SELECT *, {_EXT.format("key")} AS ext FROM k),
files AS (SELECT *, {_case("ext", C.EXTENSION_TYPES, "''")} AS document_type,
 's3watch-' || replace(key, '/', '-') AS job_id FROM typed),
listed AS (SELECT *, ext IN ({_list(C.SCAN_EXTENSIONS)}) AS allowed FROM files WHERE NOT suffix(key, '/')),
kept AS (SELECT * FROM listed WHERE allowed ORDER BY key LIMIT {C.SCAN_MAX_FILES}),
results AS (SELECT *, {I.FILE_SUCCESS} AS success FROM files WHERE document_type <> '')
"""
_BASE = "string_split(key, '/')[-1]"
ORACLES["infer_doc_type"] = FILES + "SELECT doc_id, key, ext, document_type FROM files"
ORACLES["scan_inbox"] = FILES + "SELECT key, size_bytes, ext, document_type FROM kept"
ORACLES["scan_summary"] = FILES + f"""
SELECT (SELECT count(*) FROM kept) AS total_found, count(*) AS skipped FROM listed
WHERE NOT allowed AND ((SELECT count(*) FROM kept) < {C.SCAN_MAX_FILES} OR key < (SELECT max(key) FROM kept))"""
ORACLES["url_extension"] = r"""
SELECT page_id, url, regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''),
 '[^/.][^/]*(\.[^./]*)$', 1) AS ext FROM pages"""
ORACLES["route_converter"] = FILES + f"""
SELECT doc_id, document_type, {_FAMILY} AS converter,
 CASE WHEN {_FAMILY} IS NULL THEN 'Unsupported document type: ' || document_type END AS error FROM files"""
ORACLES["archive_processed"] = FILES + f"""
SELECT key AS source_key, 'processed/' || {_BASE} AS dest_key FROM files WHERE {I.FILE_SUCCESS}"""
ORACLES["key_collisions"] = FILES + """
SELECT output_key, count(*) AS writers FROM (
 SELECT 'converted/' || string_split(regexp_replace(key, '[0-9]+', 'n', 'g'), '/')[-1] || '.txt' AS output_key FROM files)
GROUP BY output_key HAVING count(*) > 1"""
ORACLES["key_suffix"] = FILES + """
SELECT doc_id, key, CASE WHEN contains(key, '.') THEN '.' || string_split(key, '.')[-1] ELSE '' END AS suffix FROM files"""
ORACLES["expand_jobs"] = f"""
WITH m AS (SELECT page_id, {I.BATCH_MESSAGE} AS value FROM pages),
v AS (SELECT *, CASE WHEN json_valid(value) THEN value ELSE 'null' END AS j FROM m),
x AS (SELECT page_id, unnest(CASE WHEN json_type(j) <> 'ARRAY' THEN [value] WHEN json_array_length(j) = 0 THEN [NULL]
 ELSE CAST(json_extract(j, '$[*]') AS VARCHAR[]) END) AS value FROM v),
y AS (SELECT *, CASE WHEN value IS NOT NULL AND json_valid(value) THEN value ELSE 'null' END AS k FROM x)
SELECT page_id, coalesce(nullif(json_extract_string(k, '$.job_id'), ''), substr(sha256(value), 1, 12)) AS job_id,
 json_extract_string(k, '$.document_type') AS document_type, json_extract_string(k, '$.location_type') AS location_type,
 json_extract_string(k, '$.url') AS url,
 CASE WHEN json_type(k) <> 'OBJECT' THEN 'message is not a JSON object' END AS error FROM y"""
ORACLES["last_writer"] = FILES + """
SELECT output_key, doc_id, sha FROM (
 SELECT 'converted/' || string_split(regexp_replace(key, '[0-9]+', 'n', 'g'), '/')[-1] || '.txt' AS output_key,
  doc_id, sha256(text) AS sha FROM files)
QUALIFY rank() OVER (PARTITION BY output_key ORDER BY doc_id DESC) = 1"""
ORACLES["move_objects"] = """
SELECT 'txt/' || doc_id || '.txt' AS source_key, 'processed/' || doc_id || '.txt' AS dest_key, CAST(NULL AS VARCHAR) AS error FROM documents
UNION ALL SELECT 'gone/lost-' || doc_id || '.txt', 'processed/lost-' || doc_id || '.txt', 'source not found'
FROM documents WHERE doc_id % 50 = 0"""
ORACLES["delete_objects"] = """
SELECT 'txt/' || doc_id || '.txt' AS key, doc_id % 3 <> 0 AS deleted, CAST(NULL AS VARCHAR) AS error FROM documents
UNION ALL SELECT 'web/' || page_id || '.HTML', false, NULL FROM pages"""
ORACLES["watch_results"] = FILES + f"""
SELECT key, success, CASE WHEN success THEN 'converted/' || {_BASE} || '.txt' END AS output_key,
 CASE WHEN success THEN size_bytes ELSE 0 END AS total_chars,
 CASE WHEN NOT success THEN 'conversion failed' END AS error FROM results"""
ORACLES["watch_summary"] = FILES + """
SELECT count(*) AS total_scanned, (SELECT count(*) FROM results WHERE success) AS total_converted,
 count(*) - (SELECT count(*) FROM results WHERE success) AS total_failed FROM files"""
ORACLES["write_text"] = FILES + """
SELECT 'converted/doc-' || doc_id || '.txt' AS output_key, document_type,
 length(text) AS total_chars, sha256(text) AS sha FROM files"""
STORED = """
WITH stored AS (
 SELECT 'txt/' || doc_id || '.txt' AS key, 'txt' AS document_type, text AS body, doc_id AS n FROM documents
 UNION ALL SELECT 'web/' || page_id || '.HTML', 'html', html, page_id FROM pages)
"""
ORACLES["read_documents"] = STORED + """
SELECT key, CAST(strlen(body) AS BIGINT) AS size_bytes, document_type, sha256(body) AS sha FROM stored"""
ORACLES["read_parts"] = STORED + """
SELECT key, CAST(strlen(body) AS BIGINT) AS size_bytes, document_type, greatest(1, CAST(ceil(strlen(body) / 1000) AS BIGINT)) AS parts,
 CAST(NULL AS VARCHAR) AS error, sha256(body) AS sha FROM stored"""
ORACLES["scan_changes"] = """
WITH t AS (SELECT doc_id, 'txt/' || lpad(CAST(doc_id % 20 AS VARCHAR), 2, '0') || '/' || doc_id || '.txt' AS key,
 CAST(strlen(text) AS BIGINT) AS size FROM documents),
p AS (SELECT page_id, 'web/' || page_id || '.html' AS key, CAST(strlen(html) AS BIGINT) AS size FROM pages)
SELECT CAST(1 AS BIGINT) AS run, key, size AS size_bytes, 'txt' AS document_type, 'new' AS change FROM t
UNION ALL SELECT 2, key, size, 'html', 'new' FROM p WHERE page_id % 2 = 0
UNION ALL SELECT 3, key, size, 'txt', 'gone' FROM t WHERE doc_id % 3 = 0
UNION ALL SELECT 3, key, size + 14, 'html', 'changed' FROM p WHERE page_id % 14 = 0"""
ORACLES["fetch_objects"] = """
SELECT doc_id, 'txt/' || doc_id || '.txt' AS key, sha256(text) AS sha FROM documents
UNION ALL SELECT doc_id, 'gone/' || doc_id || '.txt', NULL FROM documents WHERE doc_id % 50 = 0"""
_LIMIT = int(0.5 * 1024 * 1024)
ORACLES["validate_document"] = f"""
WITH d AS (SELECT doc_id, text AS body FROM documents
 UNION ALL SELECT -1 - doc_id, CASE doc_id % 50 WHEN 0 THEN '' WHEN 2 THEN repeat(text, CAST(ceil(600000 / strlen(text)) AS BIGINT)) END
 FROM documents WHERE doc_id % 50 < 3),
s AS (SELECT *, coalesce(strlen(body), 0) AS n FROM d),
v AS (SELECT *, CASE WHEN body IS NULL THEN 'File not found'
 WHEN n > {_LIMIT} THEN 'File too large: ' || n || ' bytes (max {_LIMIT})'
 WHEN n = 0 THEN 'File is empty' END AS validation_error FROM s)
SELECT doc_id, n AS file_size_bytes, validation_error, validation_error IS NULL AS valid,
 CASE WHEN validation_error IS NULL THEN 'text/plain' ELSE '' END AS mime_type FROM v"""
ORACLES["sniff_mime"] = r"""
SELECT 'd' || doc_id AS id, 'text/plain' AS mime_type FROM documents UNION ALL
SELECT 'p' || page_id, CASE WHEN regexp_matches(lower(html), '^\s*<(!doctype html|html|head|title|body)\b')
 THEN 'text/html' ELSE 'text/plain' END FROM pages"""

# --- extraction ------------------------------------------------------------------------
# From the rule: a hidden element starts at its whole name and lasts to its own end tag.
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)" + "".join(
    rf"|<{t}(?:[\s/][^>]*)?>.*?(?:</{t}\s*>|\z)" for t in ("script", "style", "noscript", "template")
)
_TAG = r"""(?s)</?[a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*>|</?[a-zA-Z][^>]*>|<[!?][^>]*>"""


def _html(html: str) -> str:
    visible = f"regexp_replace({html}, {_quoted(_HIDDEN)}, '<!>', 'g')"
    nodes = f"regexp_split_to_array({visible}, {_quoted(_TAG)})"
    decoded = "n"
    for ref, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        decoded = f"replace({decoded}, '{ref}', '{char}')"
    texts = f"list_transform({nodes}, lambda n: {_strip(decoded)})"
    return f"array_to_string(list_filter({texts}, lambda t: t <> ''), {NL})"


def _chunks(text: str, size: int) -> str:
    count = f"CAST(ceil(length({text}) / {size}) AS BIGINT)"
    return f"list_transform(range({count}), lambda i: substr({text}, i * {size} + 1, {size}))"


def _csv_records(text: str) -> str:
    """Fields with terminators, each rendered with what follows it, put back
    together: a record ends in a line break that no field contains."""
    field = r"""(?s)"(?:[^"]|"")*"(?:[^",\r\n][^,\r\n]*)?(?:,|\r\n|\r|\n)|"(?:[^"]|"")*\z|[^,\r\n]*(?:,|\r\n|\r|\n)"""
    ended = f"CASE WHEN {text} = '' OR suffix({text}, {NL}) THEN {text} ELSE {text} || {NL} END"
    fields = f"regexp_extract_all({ended}, {_quoted(field)})"
    bare = r"""regexp_replace(f, '(?:,|\r\n|\r|\n)$', '')"""
    closed = r"""(?s)^"((?:[^"]|"")*)(?:"([^"].*)?)?$"""
    value = (
        f"CASE WHEN f[1] = '\"' THEN replace(regexp_extract({bare}, {_quoted(closed)}, 1), '\"\"', '\"') "
        f"|| coalesce(regexp_extract({bare}, {_quoted(closed)}, 2), '') ELSE {bare} END"
    )
    rendered = f"list_transform({fields}, lambda f: {value} || CASE WHEN f[-1] = ',' THEN ' | ' ELSE chr(30) END)"
    return f"string_split(regexp_replace(array_to_string({rendered}, ''), '\\x1e$', ''), chr(30))"


def _csv_chunks(text: str, rows: int) -> str:
    count = f"CAST(ceil(len(rec) / {rows}) AS BIGINT)"
    return (
        f"list_transform(range({count}), lambda i: "
        f"array_to_string(rec[i * {rows} + 1 : i * {rows} + {rows}], {NL}) || {NL})"
    )


def _numbered(source: str, pieces: str, key: str, drop_blank: bool = False) -> str:
    keep = f" WHERE {_strip('text')} <> ''" if drop_blank else ""
    return f"""SELECT {key}, chunk_no, text FROM (
 SELECT {key}, unnest({pieces}) AS text, CAST(generate_subscripts({pieces}, 1) - 1 AS BIGINT) AS chunk_no FROM {source}){keep}"""


ORACLES["html_to_text"] = (
    f"WITH t AS (SELECT page_id, {_html('html')} AS body FROM pages), "
    f"c AS (SELECT page_id, {_chunks('body', C.CHUNK_CHARS)} AS pieces FROM t) "
    + _numbered("c", "pieces", "page_id", drop_blank=True)
)
ORACLES["csv_to_text"] = (
    f"WITH r AS (SELECT doc_id, {_csv_records('text')} AS rec FROM documents), "
    f"c AS (SELECT doc_id, {_csv_chunks('rec', 20)} AS pieces FROM r) "
    + _numbered("c", "pieces", "doc_id")
)
ORACLES["csv_parts_to_text"] = (
    f"WITH d AS (SELECT doc_id, {I.CSV_TEXT} AS text FROM documents), "
    f"r AS (SELECT doc_id, {_csv_records('text')} AS rec FROM d), "
    f"c AS (SELECT doc_id, {_csv_chunks('rec', 20)} AS pieces FROM r) "
    + _numbered("c", "pieces", "doc_id")
)
ORACLES["html_part_texts"] = (
    f"WITH t AS (SELECT page_id, {_html('html')} AS text FROM pages) SELECT page_id, text FROM t WHERE text <> ''"
)
ORACLES["decode_parts"] = "SELECT doc_id, text FROM documents"
ORACLES["decode_text"] = ORACLES["decode_parts"]
ORACLES["chunk_text"] = (
    f"WITH c AS (SELECT doc_id, {_chunks('text', 1000)} AS pieces FROM documents) "
    + _numbered("c", "pieces", "doc_id")
)
ORACLES["concat_chunks"] = """
SELECT doc_id, CAST(0 AS BIGINT) AS part_no, length(text) AS total_chars,
 CAST(ceil(length(text) / 1000) AS BIGINT) AS pages_processed, text FROM documents"""
ORACLES["document_totals"] = """
SELECT doc_id, length(text) AS total_chars, CAST(ceil(length(text) / 1000) AS BIGINT) AS pages_processed
FROM documents"""
# Only the last part of a text without a final line break is not ended by one.
ORACLES["line_parts"] = f"""
SELECT doc_id, length(text) AS total_chars,
 CAST(CASE WHEN suffix(text, {NL}) THEN 0 ELSE 1 END AS BIGINT) AS open_parts FROM documents"""
LINES = f"""
WITH l AS (SELECT doc_id, lang, source, string_split(text, {NL}) AS ls FROM documents),
lines AS (SELECT doc_id, CAST(generate_subscripts(ls, 1) AS BIGINT) AS row_no, unnest(ls) AS line FROM l),
full_lines AS (SELECT doc_id, {_strip('line')} AS line,
 CAST(row_number() OVER (PARTITION BY doc_id ORDER BY row_no) - 1 AS BIGINT) AS no
 FROM lines WHERE {_strip('line')} <> '')
"""
ORACLES["batch_rows"] = LINES + f"""
SELECT doc_id, (row_no - 1) // 50 AS chunk_no, string_agg(line, {NL} ORDER BY row_no) || {NL} AS text
FROM lines GROUP BY doc_id, (row_no - 1) // 50"""
_DOCX_LINES = f""", counted AS (SELECT l.doc_id, l.lang, l.source, count(f.no) AS n
 FROM l LEFT JOIN full_lines f USING (doc_id) GROUP BY ALL),
every AS (SELECT doc_id, no // 50 AS chunk_no, no AS pos, line FROM full_lines
 UNION ALL SELECT doc_id, n // 50, n, '[TABLE 1]' FROM counted
 UNION ALL SELECT doc_id, n // 50, n + 1, 'source | lang' FROM counted
 UNION ALL SELECT doc_id, n // 50, n + 2, source || ' | ' || lang FROM counted)
"""
_BY_CHUNK = f"SELECT doc_id, chunk_no, string_agg(line, {NL} ORDER BY pos) || {NL} AS text, CAST(NULL AS VARCHAR) AS error FROM every GROUP BY doc_id, chunk_no"
ORACLES["docx_to_text"] = LINES + _DOCX_LINES + _BY_CHUNK
ORACLES["odt_to_text"] = LINES + (
    ", every AS (SELECT doc_id, no // 50 AS chunk_no, no AS pos, line FROM full_lines) " + _BY_CHUNK
)
ORACLES["xlsx_to_text"] = LINES + f""", sized AS (SELECT doc_id, lang, source, len(ls) AS n, (len(ls) + 200) // 200 AS first_chunks FROM l),
every AS (SELECT doc_id, row_no // 200 AS chunk_no, row_no AS pos, row_no || ' | ' || line AS line FROM lines
 UNION ALL SELECT doc_id, 0, 0, '=== Sheet: Lines ===' FROM sized
 UNION ALL SELECT doc_id, first_chunks, 0, '=== Sheet: Info ===' FROM sized
 UNION ALL SELECT doc_id, first_chunks, 1, doc_id || ' |  | ' || lang || ' | ' || source FROM sized)
""" + _BY_CHUNK
ORACLES["pptx_to_text"] = LINES + f""", every AS (
 SELECT doc_id, row_no AS chunk_no, 0 AS pos, '--- Slide ' || row_no || ' ---' AS line FROM lines
  WHERE {_strip('line')} <> '' OR row_no % 3 = 0
 UNION ALL SELECT doc_id, row_no, 1, {_strip('line')} FROM lines WHERE {_strip('line')} <> ''
 UNION ALL SELECT doc_id, row_no, 2, '[NOTES] line ' || row_no FROM lines WHERE row_no % 3 = 0
 UNION ALL SELECT doc_id, len(ls) + 1, 0, '--- Slide ' || (len(ls) + 1) || ' ---' FROM l
 UNION ALL SELECT doc_id, len(ls) + 1, 1, 'source | lang' FROM l
 UNION ALL SELECT doc_id, len(ls) + 1, 2, source || ' | ' || lang FROM l)
""" + _BY_CHUNK
ORACLES["unpack_office"] = LINES + _DOCX_LINES + """
SELECT doc_id, 'document' AS kind, CAST(1 AS BIGINT) AS elements, CAST(0 AS BIGINT) AS cells, CAST(0 AS BIGINT) AS last_chunk FROM l
UNION ALL SELECT doc_id, 'paragraph', count(*), count(*), max(no // 50) FROM full_lines GROUP BY doc_id
UNION ALL SELECT doc_id, 'heading', 1, 1, n // 50 FROM counted
UNION ALL SELECT doc_id, 'row', 2, 4, n // 50 FROM counted"""
PAGES = f"""
WITH p AS (SELECT conv_id AS doc_id, turn + 1 AS page_no, {_strip(I.PAGE_NATIVE)} AS native,
 {_strip(I.PAGE_FALLBACK)} AS fallback, CASE WHEN role = 'system' THEN '[IMAGE TEXT] ' || {_strip('text')} END AS img FROM conversations),
b AS (SELECT doc_id, page_no, concat_ws({NL}, coalesce(nullif(native, ''), nullif(fallback, '')), img) AS body FROM p),
r AS (SELECT doc_id, page_no, CASE WHEN body <> '' THEN '--- Page ' || page_no || ' ---' || {NL} || body || {NL} END AS page FROM b),
docs AS (SELECT doc_id, coalesce(string_agg(page, '' ORDER BY page_no), '') AS text, count(page) AS pages_processed FROM r GROUP BY doc_id),
split AS (SELECT doc_id, text, list_filter(list_transform(
 regexp_split_to_array(text, '--- Page [0-9]+ ---\\n?'), lambda x: {_strip('x')}), lambda x: x <> '') AS pieces FROM docs),
page_texts AS (SELECT doc_id, unnest(pieces) AS text, CAST(generate_subscripts(pieces, 1) AS BIGINT) AS page_no FROM split)
""".replace("\\\\n", "\\n")
_IMAGES = r"CAST(len(regexp_extract_all(text, '\[IMAGE TEXT\]')) AS BIGINT)"
ORACLES["assemble_pages"] = PAGES + f"""
SELECT doc_id, CAST(0 AS BIGINT) AS part_no, text, length(text) AS total_chars, pages_processed,
 {_IMAGES} AS images_extracted FROM docs"""
ORACLES["split_pages"] = PAGES + "SELECT doc_id, page_no, text FROM page_texts"
ORACLES["split_part_pages"] = ORACLES["split_cut_pages"] = ORACLES["split_pages"]
ORACLES["write_pages"] = PAGES + """
SELECT 'multi/conv-' || doc_id || '/pages/conv-' || doc_id || '/page_' || lpad(CAST(page_no AS VARCHAR), 4, '0') || '.txt' AS page_key,
 page_no, text FROM page_texts"""
ORACLES["structure_flags"] = PAGES + """
SELECT doc_id, contains(text, '[TABLE') AS has_tables, contains(text, '[IMAGE TEXT]') AS has_images FROM docs"""
ORACLES["images_extracted"] = PAGES + f"""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'pdf' ELSE 'image' END AS document_type,
 CASE WHEN doc_id % 2 = 0 THEN {_IMAGES} ELSE 0 END AS images_extracted FROM docs"""
ORACLES["assemble_frames"] = f"""
WITH f AS (SELECT conv_id AS doc_id, turn + 1 AS no, {_strip(I.FRAME_TEXT)} AS body,
 count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT doc_id, CAST(0 AS BIGINT) AS part_no, coalesce(string_agg(
 CASE WHEN n > 1 THEN '--- Frame ' || no || '/' || n || ' ---' || {NL} ELSE '' END || body || {NL}, '' ORDER BY no)
 FILTER (body <> ''), '') AS text, count(*) FILTER (body <> '') AS pages_processed, max(n) AS n_frames
FROM f GROUP BY doc_id"""
ORACLES["convert_documents"] = LINES + _DOCX_LINES + f""", word AS (
 SELECT 'd' || doc_id AS doc_id, 'docx' AS document_type, string_agg(line, {NL} ORDER BY pos) || {NL} AS text,
  count(DISTINCT chunk_no) AS pages_processed, NULL AS error FROM every WHERE doc_id % 3 = 2 GROUP BY doc_id),
csv AS (SELECT doc_id, {_csv_records('text')} AS rec FROM documents WHERE doc_id % 3 = 1),
html AS (SELECT page_id, {_html('html')} AS body FROM pages),
every_doc AS (SELECT * FROM word
 UNION ALL SELECT 'd' || doc_id, 'csv', array_to_string(rec, {NL}) || {NL}, CAST(ceil(len(rec) / 200) AS BIGINT), NULL FROM csv
 UNION ALL SELECT 'p' || page_id, 'html', body, CAST(ceil(length(body) / {C.CHUNK_CHARS}) AS BIGINT), NULL FROM html
 UNION ALL SELECT 'd' || doc_id, 'txt', text, CAST(ceil(length(text) / {C.CHUNK_CHARS}) AS BIGINT), NULL FROM documents WHERE doc_id % 3 = 0
 UNION ALL SELECT 'rtf' || doc_id, 'rtf', NULL, 0, 'Unsupported document type: rtf' FROM documents WHERE doc_id % 50 = 0
 UNION ALL SELECT 'lost' || doc_id, 'txt', NULL, 0, 'File not found' FROM documents WHERE doc_id % 50 = 1)
SELECT doc_id, document_type, text, coalesce(length(text), 0) AS total_chars, pages_processed, error FROM every_doc"""
ORACLES["folder_watch_stream"] = STORED + f"""
SELECT key, 's3watch-' || replace(key, '/', '-') AS job_id, document_type, true AS success,
 'converted/' || {_BASE} || '.txt' AS output_key, length(text) AS total_chars, text
FROM (SELECT *, CASE document_type WHEN 'txt' THEN body ELSE {_html('body')} END AS text FROM stored)"""

# --- choosing ------------------------------------------------------------------------------
EXTRACTIONS = f"""
WITH x AS (SELECT doc_id, {I.EXTRACTION_TYPE} AS document_type, {I.STANDARD_TEXT} AS std, {I.ENHANCED_TEXT} AS enh FROM documents),
n AS (SELECT *, {I.visible_chars('std')} AS std_chars, {I.visible_chars('enh')} AS enh_chars FROM x),
e AS (SELECT *, std_chars < {C.MIN_CHARS_THRESHOLD} AND document_type IN ('pdf', 'image') AS escalated FROM n),
best AS (SELECT *, escalated AND enh_chars > std_chars AS better FROM e),
chosen AS (SELECT doc_id, document_type, CASE WHEN better THEN enh ELSE std END AS text, escalated,
 CAST(CASE WHEN escalated THEN 2 ELSE 1 END AS BIGINT) AS attempt,
 CASE WHEN better THEN 'enhanced' ELSE 'standard' END AS chosen,
 CASE WHEN better THEN enh_chars ELSE std_chars END AS total_chars FROM best)
"""
ORACLES["best_extraction"] = EXTRACTIONS + "SELECT * FROM chosen"
ORACLES["retry_escalation"] = EXTRACTIONS + f"""
SELECT doc_id, escalated, attempt, chosen, total_chars, '{I.OUTPUT_BUCKET}' AS output_bucket,
 'converted/' || doc_id || '.txt' AS output_key FROM chosen"""

# --- analytics ---------------------------------------------------------------------------------
TOKENS = f"WITH t AS (SELECT doc_id, text, {_words('text')} AS w FROM documents)"
ORACLES["text_stats"] = f"{TOKENS} SELECT doc_id, {_stats('text', 'w')} FROM t"
ORACLES["top_words"] = f"{TOKENS} SELECT * FROM {_top('t', 'doc_id')}"
ORACLES["language_hint"] = f"{TOKENS} SELECT doc_id, {_language('w', True)} AS language_hint FROM t"
ORACLES["language_hint_all_words"] = (
    f"{TOKENS} SELECT doc_id, {_language('w', False)} AS language_hint FROM t"
)


def _analytics(source: str, key: str) -> str:
    return f"""SELECT {key}, {_stats('text', 'w')}, {_language('w', True)} AS language_hint,
 contains(text, '[TABLE') AS has_tables, contains(text, '[IMAGE TEXT]') AS has_images, top_words
 FROM {source} JOIN {_top(source, key)} USING ({key})"""


ORACLES["analyze_text"] = f"{TOKENS} {_analytics('t', 'doc_id')}"
ORACLES["analyze_line_parts"] = ORACLES["analyze_text"]
ORACLES["analyze_parts"] = f"""
WITH j AS (SELECT role AS doc_id, string_agg(text || {NL}, '' ORDER BY conv_id * 1000 + turn) AS text
 FROM conversations GROUP BY role),
t AS (SELECT doc_id, text, {_words('text')} AS w FROM j)
{_analytics('t', 'doc_id')}"""


def _metadata(kind: str, stored: str) -> str:
    words = "CASE WHEN top_words = '' THEN [] ELSE string_split(top_words, ' ') END"
    return f"""to_json(struct_pack(job_id := job_id, document_type := '{kind}', generated_at := '{I.GENERATED_AT}',
 text_output_key := {stored}, analytics := struct_pack(total_chars := total_chars, total_words := total_words,
 total_lines := total_lines, total_pages := total_pages, language_hint := language_hint,
 avg_words_per_line := avg_words_per_line, has_tables := has_tables, has_images := has_images,
 top_words := {words})))"""


_FLOW_KEY = "'pipeline/' || job_id || '/text.txt'"
ORACLES["metadata_json"] = f"""
{TOKENS}, a AS ({_analytics('t', 'doc_id')}), j AS (SELECT 'doc-' || doc_id AS job_id, * FROM a)
SELECT job_id, CAST({_metadata('txt', _FLOW_KEY)} AS VARCHAR) AS metadata FROM j"""


def _flow(docs: str) -> str:
    return f"""
WITH d AS ({docs}),
v AS (SELECT *, CASE
 WHEN text = '' THEN 'Validation failed: File is empty' END AS error FROM d),
t AS (SELECT doc_id, text, {_words('text')} AS w FROM v WHERE error IS NULL),
a AS ({_analytics('t', 'doc_id')}),
good AS (SELECT 'doc-' || doc_id AS job_id, * FROM a),
flow AS (SELECT job_id, true AS success, NULL AS error, {_FLOW_KEY} AS text_key,
 'pipeline/' || job_id || '/metadata.json' AS metadata_key, CAST({_metadata('txt', _FLOW_KEY)} AS VARCHAR) AS metadata,
 total_chars, CAST(ceil(total_chars / {C.CHUNK_CHARS}) AS BIGINT) AS pages_processed, language_hint FROM good
 UNION ALL SELECT 'doc-' || doc_id, false, error, NULL, NULL, NULL, 0, 0, 'unknown' FROM v WHERE error IS NOT NULL)
"""


_FLOW_EVENTS = """
SELECT job_id, CAST(to_json(struct_pack(job_id := job_id, status := 'completed', text_key := text_key,
 metadata_key := metadata_key, total_chars := total_chars)) AS VARCHAR) AS payload FROM flow WHERE success"""
FLOW = _flow("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents
 UNION ALL SELECT 'empty-' || doc_id, '' FROM documents WHERE doc_id % 50 = 0""")
ORACLES["document_flow"] = FLOW + "SELECT * FROM flow"
ORACLES["flow_completed_events"] = FLOW + _FLOW_EVENTS
MULTI = PAGES + f""", src AS (SELECT 'conv-' || doc_id AS job_id, text, pieces FROM split),
tok AS (SELECT job_id, text, {_words('text')} AS w FROM src),
an AS ({_analytics('tok', 'job_id')}),
uris AS (SELECT job_id, array_to_string(list_transform(range(1, len(pieces) + 1), lambda i:
 'page_' || i || '=s3://{I.OUTPUT_BUCKET}/multi/' || job_id || '/pages/' || job_id || '/page_' || lpad(CAST(i AS VARCHAR), 4, '0') || '.txt'), ' ') AS pages FROM src)
"""
_FULL = f"'s3://{I.OUTPUT_BUCKET}/multi/' || job_id || '/full_text.txt'"
ORACLES["multi_format_output"] = MULTI + f"""
SELECT job_id, {_FULL} AS full_text, pages, CAST(to_json(struct_pack(total_words := total_words, total_pages := total_pages,
 language := language_hint, has_tables := has_tables, has_images := has_images,
 top_words := CASE WHEN top_words = '' THEN [] ELSE string_split(top_words, ' ') END)) AS VARCHAR) AS analytics,
 CAST({_metadata('pdf', _FULL)} AS VARCHAR) AS metadata,
 's3://{I.OUTPUT_BUCKET}/multi/' || job_id || '/metadata.json' AS metadata_uri FROM an JOIN uris USING (job_id)"""
ORACLES["select_outputs"] = MULTI + f"SELECT job_id, {_FULL} AS full_text FROM src"

# --- outcomes ---------------------------------------------------------------------------------------
RESULTS = f"""
WITH results AS (SELECT 'job-' || event_id AS job_id, user_id AS batch_id, event_type = 'purchase' AS success,
 strlen(props) AS total_chars, props FROM events WHERE event_type IN ('error', 'purchase'))
"""
ORACLES["batch_progress"] = RESULTS + """
SELECT batch_id, count(*) AS total, count(*) FILTER (success) AS completed,
 count(*) FILTER (NOT success) AS failed FROM results GROUP BY batch_id"""
ORACLES["lifecycle_events"] = RESULTS + f"""
SELECT 'conversion.started' AS event, 'job-' || event_id AS job_id,
 '{{"event":"conversion.started","job_id":"job-' || event_id || '","document_type":"' ||
 CASE WHEN user_id % 2 = 0 THEN 'html' ELSE 'txt' END || '","location_type":"s3"}}' AS payload FROM events
UNION ALL SELECT 'conversion.completed', job_id,
 '{{"event":"conversion.completed","job_id":"' || job_id || '","output_bucket":"{I.OUTPUT_BUCKET}","output_key":"converted/' ||
 job_id || '.txt","total_chars":' || total_chars || ',"pages_processed":1}}' FROM results WHERE success
UNION ALL SELECT 'conversion.failed', job_id,
 '{{"event":"conversion.failed","job_id":"' || job_id || '","error":' || to_json('failed with ' || props) || '}}'
 FROM results WHERE NOT success"""


def _retention(hours: int) -> str:
    return f"""SELECT count(*) AS files_deleted, CAST(coalesce(sum(strlen(props)), 0) AS BIGINT) AS bytes_freed
FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL {hours} HOUR"""


ORACLES["retention_report"] = _retention(C.RETENTION_HOURS)
ORACLES["maintenance"] = _retention(24 * 7)
RUNS = f"WITH runs AS (SELECT *, {I.RUN_STATUS} AS status FROM events) "
ORACLES["status_summary"] = RUNS + """
SELECT coalesce(event_type, '*') AS workflow_type, CAST(grouping(event_type) AS BIGINT) AS is_total, count(*) AS executions,
 count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'FAILED') AS failed,
 count(*) FILTER (status = 'RUNNING') AS running FROM runs GROUP BY ROLLUP (event_type)"""
ORACLES["prefix_counts"] = "SELECT event_type AS prefix, count(*) AS objects FROM events GROUP BY event_type"
ORACLES["recent_jobs"] = RUNS + f"""
SELECT 'run-' || event_id AS id, 'r' || user_id AS run_id, status, event_type AS workflow_type,
 strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS start_time,
 CASE WHEN status <> 'RUNNING' THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS close_time
FROM runs ORDER BY ts DESC, 'run-' || event_id LIMIT {C.RECENT_JOBS_LIMIT}"""
_LATEST = RUNS + """
SELECT user_id AS job_id, status, event_type AS step FROM runs
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""
ORACLES["latest_status"] = _LATEST
ORACLES["latest_status_stream"] = ORACLES["latest_status_levels"] = _LATEST
ORACLES["step_outcomes"] = """
SELECT s.event_id AS start_id, s.user_id AS job_id,
 CASE f.event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'overdue' END AS outcome,
 strftime(f.ts, '%Y-%m-%d %H:%M:%S.%f') AS finished_at
FROM (SELECT * FROM events WHERE event_type = 'view') s
LEFT JOIN (SELECT * FROM events WHERE event_type IN ('purchase', 'error')) f
 ON f.user_id = s.user_id AND f.ts >= s.ts AND f.ts <= s.ts + INTERVAL 6 HOUR"""
# Each run knows the jobs of those before it.
ORACLES["dedupe_runs"] = """
SELECT user_id AS job_id, arg_min(event_id, row(event_id % 3, ts, event_id)) AS event_id FROM events GROUP BY user_id"""
ORACLES["dedupe_stream"] = "SELECT DISTINCT user_id AS job_id FROM events"
ORACLES["dedupe_jobs"] = """
SELECT 'job-' || user_id AS job_id, event_type, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1"""

# --- end to end ---------------------------------------------------------------------------------------


def _batch(cases: str) -> str:
    return f"""
WITH src AS (SELECT doc_id, 'doc-' || doc_id AS job_id, text, {_csv_records('text')} AS rec, {cases}),
conv AS (SELECT job_id, c, CASE c WHEN 1 THEN 'csv' WHEN 2 THEN 'rtf' ELSE 'txt' END AS document_type,
 CASE c WHEN 2 THEN 'Unsupported document type: rtf' WHEN 3 THEN 's3_bucket and s3_key are required for S3 location'
  WHEN 4 THEN 'Document not found: lost/in/' || doc_id || '.txt' END AS error,
 CASE WHEN c = 1 THEN array_to_string(rec, {NL}) || {NL} WHEN c NOT IN (2, 3, 4) THEN text END AS text,
 CASE WHEN c = 1 THEN CAST(ceil(len(rec) / 200) AS BIGINT) WHEN c IN (2, 3, 4) THEN 0
  ELSE CAST(ceil(length(text) / {C.CHUNK_CHARS}) AS BIGINT) END AS pages_processed FROM src),
batch AS (SELECT job_id, error IS NULL AS success, CASE WHEN error IS NULL THEN '{I.OUTPUT_BUCKET}' END AS output_bucket,
 CASE WHEN error IS NULL THEN 'converted/' || job_id || '.txt' END AS output_key, error, pages_processed,
 coalesce(length(text), 0) AS characters_extracted, text, document_type FROM conv)
"""


_BATCH_EVENTS = """
SELECT 'conversion.started' AS event, job_id, '{"event":"conversion.started","job_id":"' || job_id ||
 '","document_type":"' || document_type || '","location_type":"s3"}' AS payload FROM batch
UNION ALL SELECT 'conversion.completed', job_id, '{"event":"conversion.completed","job_id":"' || job_id ||
 '","output_bucket":"' || output_bucket || '","output_key":"' || output_key || '","total_chars":' ||
 characters_extracted || ',"pages_processed":' || pages_processed || '}' FROM batch WHERE success
UNION ALL SELECT 'conversion.failed', job_id, '{"event":"conversion.failed","job_id":"' || job_id ||
 '","error":"' || error || '"}' FROM batch WHERE NOT success"""
BATCH = _batch("""c FROM (
 SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, doc_id % 2 AS c FROM documents
 UNION ALL SELECT 'bad-' || doc_id, text, 2 + doc_id % 50 FROM documents WHERE doc_id % 50 < 3)""")
ORACLES["convert_batch"] = BATCH + "SELECT * EXCLUDE (document_type) FROM batch"
ORACLES["conversion_with_events"] = BATCH + _BATCH_EVENTS
WATCH = FILES + f""", run AS (SELECT *, document_type IN ('html', 'txt', 'csv') AS ok FROM listed WHERE allowed),
csv AS (SELECT key, {_csv_records('text')} AS rec FROM run WHERE document_type = 'csv'),
outcome AS (SELECT run.key, ok AS success, CASE WHEN ok THEN 'converted/' || string_split(run.key, '/')[-1] || '.txt' END AS output_key,
 CASE document_type WHEN 'txt' THEN length(text) WHEN 'html' THEN length({_html('text')})
  WHEN 'csv' THEN length(array_to_string(rec, {NL})) + 1 ELSE 0 END AS total_chars, NOT ok AS failed
 FROM run LEFT JOIN csv ON run.key = csv.key)
"""
ORACLES["folder_watch"] = WATCH + "SELECT * FROM outcome"
ORACLES["folder_watch_summary"] = WATCH + """
SELECT count(*) AS total_scanned, count(*) FILTER (success) AS total_converted,
 count(*) FILTER (NOT success) AS total_failed FROM outcome"""
