"""End-to-end flows: stage flags, failures as rows, reports."""

import datetime as dt
import json

import pytest

from leafwork.operators import analyze, jobs
from leafwork.plans import flows
from leafwork.workload import archives

DOCS = [
    ("t", "txt", b"the cat\r\nsat"), ("h", "html", b"<p>hi &amp; bye<p>you"), ("c", "csv", b"a,b\n1,2\n"),
    ("e", "txt", b""), ("r", "rtf", b"{\\rtf1}"), ("w", "docx", archives.docx(["word one"], [[["x", "y"]]])),
]


@pytest.fixture
def documents(rows):
    return rows("job_id string, document_type string, content binary", *DOCS)


def test_document_flow(documents):
    out = {r["job_id"]: r for r in flows.document_flow(documents, "2024-01-01T00:00:00+00:00").collect()}
    assert {k: (r["success"], r["error"]) for k, r in out.items()} == {
        "t": (True, None), "h": (True, None), "c": (True, None), "w": (True, None),
        "e": (False, "Validation failed: File is empty"), "r": (False, "Unsupported document type: rtf"),
    }
    assert out["w"]["text"] == "word one\n[TABLE 1]\nx | y\n" and out["w"]["has_tables"]
    assert out["c"]["text"] == "a | b\n1 | 2\n" and out["h"]["text"] == "hi & bye\nyou"
    meta = json.loads(out["t"]["metadata"])
    assert meta["text_output_key"] == "pipeline/t/text.txt"
    assert meta["analytics"] == {
        "total_chars": 11, "total_words": 3, "total_lines": 2, "total_pages": 0, "language_hint": "unknown",
        "avg_words_per_line": 1.5, "has_tables": False, "has_images": False, "top_words": ["cat", "sat"],
    }
    assert out["t"]["metadata_key"] == "pipeline/t/metadata.json"
    assert out["e"]["metadata"] is None and out["e"]["text_key"] is None


def test_document_flow_stages_can_be_left_out(documents):
    bare = flows.document_flow(documents, "now", enable_validation=False, enable_analytics=False)
    assert not {"metadata", "total_words", "language_hint"} & set(bare.columns)
    assert {r["job_id"]: r["success"] for r in bare.collect()}["e"]  # nothing rejects an empty file now
    no_meta = flows.document_flow(documents, "now", enable_metadata=False)
    assert "total_words" in no_meta.columns and "metadata" not in no_meta.columns


def test_size_limit(documents):
    out = flows.document_flow(documents, "now", max_mb=10 / 1024 / 1024).where("job_id = 't'").first()
    assert out["error"] == "Validation failed: File too large: 12 bytes (max 10)"


def test_multi_format_flags(rows):
    docs = rows("job_id string, document_type string, text string", ("j", "pdf", "--- Page 1 ---\nA\n--- Page 2 ---\nB\n"))
    out = flows.multi_format_output(docs, "b", "now").first()
    assert out["full_text"] == "s3://b/multi/j/full_text.txt"
    assert out["pages"] == {
        "page_1": "s3://b/multi/j/pages/j/page_0001.txt", "page_2": "s3://b/multi/j/pages/j/page_0002.txt",
    }
    assert out["analytics"]["total_pages"] == 2
    assert json.loads(out["metadata"])["text_output_key"] == out["full_text"]
    less = flows.multi_format_output(docs, "b", "now", full_text=False, pages=False)
    assert less.columns == ["job_id", "analytics", "metadata", "metadata_uri"]
    assert json.loads(less.first()["metadata"])["text_output_key"] == ""
    assert flows.multi_format_output(docs, "b", "now", analytics=False).columns == ["job_id", "full_text", "pages"]


def test_convert_batch_keeps_every_job(rows):
    messages = [
        {"job_id": "1", "document_type": "txt", "location_type": "s3", "s3_bucket": "b", "s3_key": "k1"},
        {"job_id": "2", "document_type": "html", "location_type": "url", "url": "http://h/p", "output_s3_key": "mine.txt", "output_s3_bucket": ""},
        {"job_id": "3", "document_type": "docx", "location_type": "ftp", "ftp_host": "h", "ftp_path": "/w.docx", "output_s3_bucket": "own"},
        {"job_id": "4", "document_type": "txt", "location_type": "s3", "s3_bucket": "b", "s3_key": "none"},
        {"job_id": "5", "document_type": "txt", "location_type": "local"},
        {"job_id": "6", "document_type": "mp3", "location_type": "url"},
    ]
    accepted = jobs.validate_jobs(jobs.parse_jobs(rows("value string", *[(json.dumps(m),) for m in messages])))
    stored = rows("key string, content binary", ("k1", b"one"), ("http://h/p", b"<b>two</b>"), ("/w.docx", archives.docx(["three"])))
    out = {r["job_id"]: r for r in flows.convert_batch(accepted, stored, "texts").collect()}
    assert {k: (r["output_bucket"], r["output_key"], r["text"], r["error"]) for k, r in out.items()} == {
        "1": ("texts", "converted/1.txt", "one", None),
        "2": ("texts", "mine.txt", "two", None),
        "3": ("own", "converted/3.txt", "three\n", None),
        "4": (None, None, None, "Document not found: none"),
        "5": (None, None, None, "LOCAL location requires a local_file_path"),
        "6": (None, None, None, "unknown document_type: mp3"),
    }


def test_events_of_a_conversion(rows):
    made = rows(
        "job_id string, document_type string, location_type string, s3_key string, url string, ftp_path string, output_s3_bucket string, output_s3_key string, error string",
        ("1", "txt", "s3", "k", None, None, None, None, None), ("2", "txt", "s3", "lost", None, None, None, None, None),
    )
    stored = rows("key string, content binary", ("k", b"abc"))
    told = flows.conversion_with_events(made, stored, "texts").collect()
    assert sorted((r["event"], r["job_id"]) for r in told) == [
        ("conversion.completed", "1"), ("conversion.failed", "2"), ("conversion.started", "1"), ("conversion.started", "2"),
    ]
    failed = next(r for r in told if r["event"] == "conversion.failed")
    assert json.loads(failed["payload"])["error"] == "Document not found: lost"


def test_maintenance_of_a_folder(spark, tmp_path):
    (tmp_path / "old.txt").write_text("12345")
    later = dt.datetime(2100, 1, 1)
    assert flows.folder_maintenance(spark, str(tmp_path), later).first() == (1, 5, [])
    gone = flows.folder_maintenance(spark, str(tmp_path / "none"), later).first()
    assert gone == (0, 0, ["Directory not found"])


def test_own_stop_words(rows):
    docs = rows("text string", ("the cat the dog",))
    assert analyze.top_words(docs, stop_words=["cat"]).first()["top_words"] == ["the", "dog"]
    assert analyze.top_words(docs, stop_words=[]).first()["top_words"] == ["the", "cat", "dog"]


def test_all_words_mode_in_the_flow(rows):
    docs = rows("job_id string, document_type string, content binary", ("1", "txt", b"the cat and that hat"))
    out = flows.document_flow(docs, "now", language_mode="all_words").first()
    assert out["language_hint"] == "en"
