"""Hand-computed results for every quirk of the semantics."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from leafwork.functions import content, csv, html, paths, text
from leafwork.operators import analyze, extract, files, jobs, outcomes, outputs

ANALYTICS = [
    # text, chars, words, lines, pages, average, language, tables, images, top words
    ("The cat and the hat sat with that cat.", 38, 9, 1, 0, 9.0, "unknown", False, False, "cat hat sat"),
    ("der Hund und die Katze\n", 23, 5, 1, 0, 5.0, "de", False, False, "der hund und die katze"),
    ("que\n", 4, 1, 1, 0, 1.0, "es", False, False, "que"),
    ("beta alpha beta alpha gamma", 27, 5, 1, 0, 5.0, "unknown", False, False, "beta alpha gamma"),
    ("naïve café abc1 abc_d abc-def ABC", 33, 3, 1, 0, 3.0, "unknown", False, False, "abc def"),
    ("", 0, 0, 0, 0, 0.0, "unknown", False, False, ""),
    ("\n", 1, 0, 1, 0, 0.0, "unknown", False, False, ""),
    ("a\r\nb\rc", 5, 0, 3, 0, 0.0, "unknown", False, False, ""),
    (
        "--- Page 1 ---\nfoo [TABLE 1]\n--- Page 2 ---\n[IMAGE TEXT] bar\n",
        61, 7, 4, 2, 1.75, "unknown", True, True, "page foo table image text bar",
    ),
    ("x\u2028--- Page 9", 12, 1, 1, 0, 1.0, "unknown", False, False, "page"),
]


def _values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_analyze_text(rows):
    docs = rows("doc_id int, text string", *[(i, a[0]) for i, a in enumerate(ANALYTICS)])
    out = analyze.analyze_text(docs).orderBy("doc_id")
    got = _values(
        out, "total_chars", "total_words", "total_lines", "total_pages", "avg_words_per_line",
        "language_hint", "has_tables", "has_images", "top_words",
    )
    assert [(*g[:-1], " ".join(g[-1])) for g in got] == [a[1:] for a in ANALYTICS]


def test_language_modes(rows):
    docs = rows("text string", (ANALYTICS[0][0],))
    assert analyze.language_hint(docs).first()["language_hint"] == "unknown"
    assert analyze.language_hint(docs, mode="all_words").first()["language_hint"] == "en"
    with pytest.raises(ValueError):
        analyze.language_hint(docs, mode="other")


# Means beyond 2**20 follow the same rule.
LARGE = [(2**31 - 1, 1000), (2**33 + 1, 8), (10**12 + 7, 40), (3 * 10**9 + 5, 200)]


def test_average_rounds_half_to_even(rows):
    df = rows("w long, l long", (1, 8), (3, 8), (1, 3), (5, 2), (4, 0), (107, 40), (749, 40), (0, 7), *LARGE)
    got = [r[0] for r in df.select(text.average(F.col("w"), F.col("l"))).collect()]
    assert got == [0.12, 0.38, 0.33, 2.5, 4.0, 2.67, 18.73, 0.0, *[round(w / n, 2) for w, n in LARGE]]


def test_top_words_limit_and_null_text(rows):
    many = " ".join(f"word{chr(97 + i)}" for i in range(25)) + " wordz wordz"
    docs = rows("text string", (many,), (None,))
    first, second = (r["top_words"] for r in analyze.top_words(docs).collect())
    assert len(first) == 20 and first[0] == "wordz" and first[1] == "worda"
    assert second == []


PAGES = [
    ("--- Page 1 ---\nA\n--- Page 2 ---\n\n--- Page 3 ---\nC\n", ["A", "C"]),
    ("intro\n--- Page 1 ---\nA\n", ["intro", "A"]),
    ("no marker", ["no marker"]),
    ("x --- Page 7 --- y", ["x", "y"]),
    ("  \n", []),
]


def test_split_pages(rows):
    docs = rows("job_id string, text string", *[(f"j{i}", p[0]) for i, p in enumerate(PAGES)])
    out = outputs.split_pages(docs, job_id="job_id").orderBy("job_id", "page_no")
    assert _values(out, "job_id", "page_no", "text") == [
        (f"j{i}", n, t) for i, p in enumerate(PAGES) for n, t in enumerate(p[1], start=1)
    ]
    assert out.first()["page_key"] == "multi/j0/pages/j0/page_0001.txt"


KEYS = [
    ("inbox/a.PDF", ".pdf", "pdf"), ("inbox/.pdf", "", ""), ("inbox/b.tar.gz", ".gz", ""),
    ("inbox/c", "", ""), ("inbox/d.", ".", ""), ("inbox.d/e", "", ""),
    ("inbox/..f.txt", ".txt", "txt"), ("inbox/p.htm", ".htm", "html"), ("inbox/q.doc", ".doc", "docx"),
]


def test_infer_doc_type(rows):
    out = files.infer_doc_type(rows("key string", *[(k[0],) for k in KEYS]))
    assert _values(out, "key", "ext", "document_type") == KEYS


def test_default_scan_keeps_only_allowed_extensions(rows):
    listing = rows("key string", *[(k[0],) for k in KEYS], ("inbox/sub/",))
    kept = sorted(r["key"] for r in files.scan_inbox(listing).collect())
    assert kept == ["inbox/..f.txt", "inbox/a.PDF"]
    assert files.scan_summary(listing).first() == (2, 7)


@pytest.mark.parametrize(
    "cap, kept, skipped",
    [(2, ["a.txt", "c.txt"], 1), (3, ["a.txt", "c.txt", "e.txt"], 2),
     (100, ["a.txt", "c.txt", "e.txt"], 2), (0, ["a.txt"], 0)],
)
def test_scan_cap(rows, cap, kept, skipped):
    listing = rows("key string", *[(k,) for k in ("a.txt", "b.zip", "c.txt", "d.zip", "e.txt")])
    assert [r["key"] for r in files.scan_inbox(listing, cap).collect()] == kept
    assert files.scan_summary(listing, cap).first() == (len(kept), skipped)


def test_scan_of_nothing(rows):
    assert files.scan_summary(rows("key string", ("x/",))).first() == (0, 0)


def test_url_extension(rows):
    urls = [
        ("https://h.example/a/b.html?x=1.pdf#f.txt", ".html"), ("http://h.example", ""),
        ("http://h.example/a.HTML;v=1", ".HTML"), ("/pub/f.tar.gz", ".gz"), ("http://h.example/.rc", ""),
    ]
    out = files.url_extension(rows("url string", *[(u,) for u, _ in urls]))
    assert [r["ext"] for r in out.collect()] == [e for _, e in urls]


def test_key_suffix_looks_at_the_whole_key(rows):
    df = rows("k string", ("in.d/e",), ("a.b.txt",), ("plain",))
    got = [r[0] for r in df.select(paths.key_suffix(F.col("k"))).collect()]
    assert got == [".d/e", ".txt", ""]


def test_validate_document(rows):
    mb = 1_048_576
    df = rows(
        "id int, content binary, n long",
        (1, b"x", mb), (2, b"x", mb + 1), (3, b"", 0), (4, None, None),
    )
    out = files.validate_document(df, size=F.col("n"), max_mb=1).orderBy("id")
    assert _values(out, "valid", "validation_error") == [
        (True, None),
        (False, f"File too large: {mb + 1} bytes (max {mb})"),
        (False, "File is empty"),
        (False, "File not found"),
    ]
    empty = files.validate_document(rows("content binary", (b"",)), max_mb=0)
    assert empty.first()["validation_error"] == "File is empty"


JOB = '"document_type":"pdf","location_type":"s3"'
MESSAGES = [
    ("{" + JOB + ',"ftp_port":"21","extra":1}', None, 21),
    ("{bad", "message is not a JSON object", 21),
    ('{"document_type":"mp3","location_type":"s3"}', "unknown document_type: mp3", 21),
    ('{"location_type":"s3"}', "document_type is required", 21),
    ("{" + JOB + ',"ftp_port":null}', "ftp_port is not an integer", 21),
    ("{" + JOB + ',"ftp_port":"x"}', "ftp_port is not an integer", 21),
    ("{" + JOB + ',"ftp_port":2121}', None, 2121),
    ("{" + JOB + ',"auth_type":null}', "auth_type is required", 21),
    ("{" + JOB + ',"auth_type":"magic"}', "unknown auth_type: magic", 21),
    ("[1]", "message is not a JSON object", 21),
    ("{" + JOB + ',"url":5}', "url is not text", 21),
    ("{" + JOB + ',"job_id":{"a":1},"ftp_port":22.0}', "job_id is not text", 22),
    ("{" + JOB + ',"url":null,"other":[1,{"url":2}],"ftp_port":" 23 "}', None, 23),
    ("{" + JOB + ',"ftp_port":21.5}', "ftp_port is not an integer", 21),
]


def test_parse_jobs(rows):
    df = rows("n int, value string", *[(i, m[0]) for i, m in enumerate(MESSAGES)])
    out = jobs.parse_jobs(df).orderBy("n")
    assert _values(out, "error", "ftp_port") == [m[1:] for m in MESSAGES]
    first = out.first()
    assert first["auth_type"] == "none" and len(first["job_id"]) == 12 and first["raw"] is None


def test_secrets_never_leave_parsing(rows):
    secret = '{"document_type":"zzz","ftp_pass":"hun\\"ter","auth_token" : "tok", "auth_password":12}'
    out = jobs.parse_jobs(rows("value string", (secret,))).first()
    assert out["raw"] == (
        '{"document_type":"zzz","ftp_pass":"***","auth_token" : "***", "auth_password":"***"}'
    )
    assert not {"ftp_pass", "auth_token", "auth_password", "ftp_user"} & set(out.asDict())


def test_messages_are_read_strictly(rows):
    job = '"document_type":"html","location_type":"url","url":"u"'
    messages = [
        '{"job_id":"a",' + job + ',"job_id":"b"}', '{"job_id":"a",' + job + '} x}', '{"job_id":"a",' + job + '}{"b":1}',
        '{"job_id":"a",' + job + '},{"b":1}', '{"job_id":"a"}],[{"b":1}', '{"job_id":"a"}} , {"b":{"c":1}', ' {"job_id":"a",' + job + "}\n",
        '{"job_id":"a",' + job + ',"auth_token":["x","y\\"]"],"n":1}', '{"job_id":"a",' + job + ',"ftp_pass":{"x":"y"}}',
        '{"job_id":"a",' + job + ',"auth\\u005ftoken":"x y","url":3}', '{"auth_token":["x", "y"], ' + job, '{"ftp_pass":"x"} y}',
    ]
    got = _values(jobs.parse_jobs(rows("n int, value string", *enumerate(messages))).orderBy("n"), "job_id", "error", "raw")
    bad = "message is not a JSON object"
    assert got[0] == ("b", None, None) and got[6] == ("a", None, None)
    assert [g[1] for g in got[1:6]] == [bad] * 5 and [g[2] for g in got[1:6]] == messages[1:6]
    assert got[7][1:] == ("auth_token is not text", '{"job_id":"a",' + job + ',"auth_token":"***","n":1}')
    assert got[8][1:] == ("ftp_pass is not text", '{"job_id":"a",' + job + ',"ftp_pass":"***"}')
    assert got[9][1:] == ("url is not text", '{"job_id":"a",' + job + ',"auth_token":"***","url":3}')
    assert [g[1:] for g in got[10:]] == [(bad, '{"auth_token":"***"'), (bad, '{"ftp_pass":"***"} y}')]


def test_expand_batches(rows):
    df = rows("n int, value string", (1, '[{"a":1},{"b":2}]'), (2, '{"c":3}'), (3, "{bad"))
    got = _values(jobs.expand_batches(df).orderBy("n", "value"), "n", "value")
    assert got == [(1, '{"a":1}'), (1, '{"b":2}'), (2, '{"c":3}'), (3, "{bad")]


def test_validate_jobs(rows):
    schema = "location_type string, s3_bucket string, s3_key string, url string, ftp_host string, ftp_path string, path string"
    df = rows(
        schema,
        ("s3", "b", "", None, None, None, None),
        ("url", None, None, None, None, None, None),
        ("ftp", None, None, None, "h", None, None),
        ("local", None, None, None, None, None, None),
        ("s3", "b", "k", None, None, None, None),
        ("url", None, None, "", None, None, "/tmp/x"),
    )
    out = jobs.validate_jobs(df, local_path="path")
    assert [r["error"] for r in out.collect()] == [
        "s3_bucket and s3_key are required for S3 location",
        "url is required for URL location",
        "ftp_host and ftp_path are required for FTP location",
        "LOCAL location requires a local_file_path",
        None,
        None,
    ]


def test_best_extraction(rows):
    cases = [
        ("pdf", 30, 450, True, "enhanced"), ("pdf", 30, 30, True, "standard"),
        ("pdf", 50, 450, False, "standard"), ("docx", 10, 450, False, "standard"),
        ("image", 0, 0, True, "standard"), ("pdf", 10, None, True, "standard"),
    ]
    standard = rows(
        "doc_id int, document_type string, text string, total_chars long",
        *[(i, c[0], "s", c[1]) for i, c in enumerate(cases)],
    )
    enhanced = rows(
        "doc_id int, text string, total_chars long",
        *[(i, "e", c[2]) for i, c in enumerate(cases) if c[2] is not None],
    )
    out = outcomes.best_extraction(standard, enhanced).orderBy("doc_id")
    assert _values(out, "escalated", "chosen") == [c[3:] for c in cases]
    assert out.first()["total_chars"] == 450 and out.first()["attempt"] == 2


def test_assemble_pages_and_split_again(rows):
    pages = rows(
        "doc_id int, page_no int, native string, fallback string, images array<string>",
        (1, 3, "", "C", []), (1, 1, "A", None, ["cat", " "]), (1, 2, " ", "", None), (2, 1, "", "", []),
    )
    out = extract.assemble_pages(pages).orderBy("doc_id")
    first, second = out.collect()
    assert first["text"] == "--- Page 1 ---\nA\n[IMAGE TEXT] cat\n--- Page 3 ---\nC\n"
    assert (first["pages_processed"], first["images_extracted"]) == (2, 1)
    assert (second["text"], second["total_chars"], second["pages_processed"]) == ("", 0, 0)
    split = outputs.split_pages(out.select("doc_id", "text")).orderBy("page_no")
    assert _values(split, "page_no", "text") == [(1, "A\n[IMAGE TEXT] cat"), (2, "C")]


def test_assemble_frames(rows):
    frames = rows(
        "doc_id int, frame_no int, text string",
        (1, 1, "x"), (1, 2, " "), (1, 3, "z"), (2, 1, "x"), (3, 1, ""),
    )
    out = extract.assemble_frames(frames).orderBy("doc_id")
    assert [r["text"] for r in out.collect()] == [
        "--- Frame 1/3 ---\nx\n--- Frame 3/3 ---\nz\n", "x\n", "",
    ]


def test_chunk_text(rows):
    docs = rows("doc_id int, text string", (1, "abcdefg"), (2, ""), (3, "abc   d"), (4, "aé😀\nb"))
    keep = extract.chunk_text(docs, size=3).orderBy("doc_id", "chunk_no")
    assert _values(keep, "doc_id", "chunk_no", "text") == [
        (1, 0, "abc"), (1, 1, "def"), (1, 2, "g"), (3, 0, "abc"), (3, 1, "   "), (3, 2, "d"),
        (4, 0, "aé😀"), (4, 1, "\nb"),
    ]
    dropped = extract.chunk_text(docs, size=3, drop_blank=True).where("doc_id = 3")
    assert sorted(r["text"] for r in dropped.collect()) == ["abc", "d"]


CSV = [
    ('a,"b, c",,"d ""q"" e"', ['a | b, c |  | d "q" e']), (",a", [" | a"]), ("a,,", ["a |  | "]),
    ("a\n\nb", ["a", "", "b"]), ("", []), ('"x\ny",z\r\nq', ["x\ny | z", "q"]),
    ('a"b,c', ['a"b | c']), ('"open, a\nb', ["open, a\nb"]),
]


def test_csv_records(rows):
    df = rows("t string", *[(c[0],) for c in CSV])
    got = [r[0] for r in df.select(csv.csv_records(F.col("t"))).collect()]
    assert got == [c[1] for c in CSV]


def test_csv_chunks(rows):
    body = "\n".join(f"{i},x" for i in range(5))
    out = extract.csv_to_text(rows("doc_id int, text string", (1, body), (2, "")), rows_per_chunk=2)
    assert _values(out.orderBy("chunk_no"), "doc_id", "chunk_no", "text") == [
        (1, 0, "0 | x\n1 | x\n"), (1, 1, "2 | x\n3 | x\n"), (1, 2, "4 | x\n"),
    ]


HTML = [
    ("<!DOCTYPE html><html><head><title>T</title></head><body><h1>Hi</h1><p>a &amp; b</p></body></html>", "T\nHi\na & b"),
    ("a<!-- x <p>no</p> -->b", "a\nb"),
    ('<script>var a = "</p>";</script>t<style>p{}</style><noscript>n</noscript>', "t"),
    ('<p title="a>b">hi</p><br/>yo <b>z</b>', "hi\nyo\nz"),
    ("<SCRIPT src='x'>y</script >z", "z"), ("<style>unclosed", ""),
    ("&amp;lt; &#233;&#xE9;&#65 &copy 2 &bogus; [&#0;&#xD800;&#99999999999999999999;] x&y &amp-;", "&lt; ééA &copy 2 &bogus; [] x&y &amp-;"),
    ("\xa0 x \u2003", "x"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"), ("&#128512;", "😀"), ("", ""),
]


def test_html_text(rows):
    df = rows("h string", *[(h[0],) for h in HTML])
    assert [r[0] for r in df.select(html.html_text(F.col("h"))).collect()] == [h[1] for h in HTML]


def test_decode_text(rows):
    df = rows(
        "b binary",
        (b"\xef\xbb\xbfa\r\nb",), ("é".encode(),), (b"caf\xe9 \x80 \x93q\x94",),
        ("hé".encode("utf-16"),), (b"a\rb\n",), (b"",),
    )
    got = [r[0] for r in df.select(content.decode_text(F.col("b"))).collect()]
    assert got == ["a\nb", "é", "café € “q”", "hé", "a\nb\n", ""]


def zipped(*names, body=bytes(range(256)) * 40):
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as archive:
        for name in names:
            archive.writestr(name, body)
    return made.getvalue()


def test_sniff_mime(rows):
    known = {
        b"%PDF-1.7 x": "application/pdf", b"{\\rtf1 x": "text/rtf", b"\x89PNG\r\n\x1a\nx": "image/png",
        b"\xff\xd8\xff\xe0": "image/jpeg", b"II*\x00x": "image/tiff", b"BM123": "image/bmp",
        b"RIFF\x01\x02\x03\x04WEBPVP8": "image/webp", b"  <!DOCTYPE html><p>": "text/html",
        b"plain": "text/plain", b"\xff\x00\xfe": "application/octet-stream",
        zipped("word/document.xml"): "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
        zipped("other"): "application/zip",
        # The names of all members count, wherever they lie; their contents do not.
        zipped("a.bin", "xl/workbook.xml"): "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
        zipped("a.bin", body=b"word/" * 2_000): "application/zip",
    }
    out = files.sniff_mime(rows("content binary", *[(k,) for k in known]))
    assert [r["mime_type"] for r in out.collect()] == list(known.values())


def test_a_port_beyond_32_bits_is_an_error(rows):
    body = '{"document_type":"txt","location_type":"ftp","ftp_host":"h","ftp_path":"p","ftp_port":%s}'
    out = jobs.parse_jobs(rows("value string", *[(body % p,) for p in ('"99999999999"', '"2121"', "22.0", "null")]))
    assert [r["error"] for r in out.collect()] == [
        "ftp_port is out of range", None, None, "ftp_port is not an integer",
    ]


def test_retention_is_strict(rows):
    now = dt.datetime(2024, 1, 2, 12)
    old = now - dt.timedelta(hours=24)
    listing = rows(
        "key string, size_bytes long, last_modified timestamp",
        ("a", 5, old), ("b", 7, old - dt.timedelta(seconds=1)), ("c", 9, now),
    )
    assert files.retention_report(listing, now).first() == (1, 7)
    assert [r["key"] for r in files.expired(listing, now).collect()] == ["b"]
    assert files.retention_report(listing.where("false"), now).first() == (0, 0)


def test_watch_results_meet_on_the_key(rows):
    """Both keys map to one job id."""
    listing = rows(
        "job_id string, key string, document_type string", ("w-a-b-c", "a/b-c", "txt"), ("w-a-b-c", "a-b/c", "txt")
    )
    results = rows(
        "job_id string, key string, success boolean, output_key string, total_chars long, error string",
        ("w-a-b-c", "a/b-c", True, "o", 1, None), ("w-a-b-c", "a-b/c", False, None, 0, "bad"),
    )
    out = outcomes.watch_results(listing, results).orderBy("key").collect()
    assert [(r["key"], r["success"]) for r in out] == [("a-b/c", False), ("a/b-c", True)]
    assert outcomes.watch_summary(listing, results).first() == (2, 1, 1)


def test_watch_summary_counts_files_without_a_result_as_failed(rows):
    listing = rows(
        "job_id string, key string, document_type string",
        ("1", "a.txt", "txt"), ("2", "b.bin", ""), ("3", "c.txt", "txt"), ("4", "d.txt", "txt"),
    )
    results = rows(
        "job_id string, success boolean, output_key string, total_chars long, error string",
        ("1", True, "o", 1, None), ("3", False, None, 0, "bad"),
    )
    assert outcomes.watch_summary(listing, results).first() == (4, 1, 3)
    assert outcomes.watch_results(listing, results).count() == 2
    assert outcomes.watch_summary(listing.where("false"), results).first() == (0, 0, 0)


def test_dedupe_keeps_the_earliest(rows):
    log = rows("job_id string, n int, v string", ("a", 2, "late"), ("a", 1, "first"), ("b", 1, "only"))
    out = jobs.dedupe_jobs(log, ["n"]).orderBy("job_id")
    assert _values(out, "job_id", "v") == [("a", "first"), ("b", "only")]


def test_events_follow_their_targets(rows):
    made = rows("job_id string, document_type string, location_type string", ("1", "txt", "s3"))
    done = rows(
        "job_id string, success boolean, output_bucket string, output_key string, total_chars long, pages_processed long, error string",
        ("1", True, "b", "k", 3, 1, None), ("2", False, None, None, 0, 0, "bad"),
    )
    every = outputs.lifecycle_events(made, done).select("event", "payload").collect()
    assert {r["event"]: r["payload"] for r in every} == {
        "conversion.started": '{"event":"conversion.started","job_id":"1","document_type":"txt","location_type":"s3"}',
        "conversion.completed": '{"event":"conversion.completed","job_id":"1","output_bucket":"b","output_key":"k","total_chars":3,"pages_processed":1}',
        "conversion.failed": '{"event":"conversion.failed","job_id":"2","error":"bad"}',
    }
    only = outputs.lifecycle_events(made, done, on_start=False, on_failure=False)
    assert [r["event"] for r in only.collect()] == ["conversion.completed"]
    with pytest.raises(ValueError):
        outputs.lifecycle_events(made, done, False, False, False)


def test_html_hidden_elements_end_where_they_should(rows):
    from leafwork.functions.html import html_text

    cases = {
        "<p>a</p><template-card>b</template-card><p>c</p>": "a\nb\nc",
        "<style-guide>q</style-guide><p>c</p>": "q\nc",
        "<ruby>x<rt>y</ruby><p>rest</p>": "x\nrest",
        "<ruby>x<rp>(<rt>y<rp>)</ruby>z": "x\nz",
        "<p>a<script>1</script >b<template/>c</template>d": "a\nb\nd",
        "don&apos;t": "don't",
        "<!DOCTYPE html [<!ENTITY x 'b>c'>]>text": "text",
        "<!DOCTYPE html SYSTEM 'b>c'>text": "text",
        "&#" + "0" * 2000 + "65;&#x" + "0" * 2000 + "42;": "AB",
    }
    got = {r.h: r.t for r in rows("h string", *[(h,) for h in cases]).select("h", html_text(F.col("h")).alias("t")).collect()}
    assert got == cases


def test_scans_and_flows_have_no_cap_unless_given(rows):
    listing = rows("key string", *[(f"in/{k:04d}.txt",) for k in range(250)], ("in/x.zip",))
    assert files.scan_inbox(listing).count() == 250
    assert files.scan_summary(listing).first() == (250, 1)
    assert files.scan_inbox(listing, 100).count() == 100
