"""One document, job or key with a third of all rows: exact and bounded."""

import pytest
from pyspark.sql import functions as F

from leafwork.operators import analyze, extract, jobs, outcomes, outputs

PAGES = 3_000


@pytest.fixture(scope="module")
def hot_pages(spark):
    """Document 0 has a third of all pages; the others have two each."""
    hot = spark.range(1, PAGES + 1).select(F.lit(0).cast("long").alias("doc_id"), F.col("id").alias("page_no"))
    rest = spark.range(PAGES * 2).select(
        (F.floor(F.col("id") / 2) + 1).alias("doc_id"), (F.col("id") % 2 + 1).alias("page_no")
    )
    return hot.unionByName(rest).select(
        "doc_id", "page_no",
        F.concat(F.lit("page "), F.col("page_no").cast("string"), F.lit(" the cat\nund")).alias("native"),
        F.lit("").alias("fallback"), F.array().cast("array<string>").alias("images"),
    )


def test_hot_document_becomes_bounded_parts(hot_pages):
    parts = extract.assemble_pages(hot_pages, pages_per_part=100)
    hot = parts.where("doc_id = 0").orderBy("part_no").collect()
    assert len(hot) == 30 and max(r["pages_processed"] for r in hot) == 100
    joined = "".join(r["text"] for r in hot)
    assert joined == "".join(f"--- Page {i} ---\npage {i} the cat\nund\n" for i in range(1, PAGES + 1))
    assert parts.where("doc_id > 0").count() == PAGES


def test_hot_document_pages_keep_their_numbers(hot_pages):
    parts = extract.assemble_pages(hot_pages, pages_per_part=100)
    split = outputs.split_part_pages(parts).where("doc_id = 0").orderBy("page_no").collect()
    assert [(r["page_no"], r["text"]) for r in split] == [
        (i, f"page {i} the cat\nund") for i in range(1, PAGES + 1)
    ]


def test_hot_document_analytics(hot_pages):
    parts = extract.assemble_pages(hot_pages, pages_per_part=100)
    whole = extract.assemble_pages(hot_pages, pages_per_part=PAGES)
    split = analyze.analyze_parts(parts).orderBy("doc_id").collect()
    joined = analyze.analyze_text(whole).orderBy("doc_id").collect()
    for column in analyze.ANALYTICS:
        assert [r[column] for r in split] == [r[column] for r in joined], column


def test_hot_frames(spark):
    frames = spark.range(1, 501).select(F.lit(1).alias("doc_id"), F.col("id").alias("frame_no"), F.lit("x").alias("text"))
    out = extract.assemble_frames(frames, frames_per_part=100).orderBy("part_no").collect()
    assert "".join(r["text"] for r in out) == "".join(f"--- Frame {i}/500 ---\nx\n" for i in range(1, 501))
    assert {r["n_frames"] for r in out} == {500} and len(out) == 5


def test_repeated_job_ids(spark):
    log = spark.range(3_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("job_id"),
        (3_000 - F.col("id")).alias("n"),
    )
    out = jobs.dedupe_jobs(log, ["n"])
    assert out.count() == 2_001
    assert out.where("job_id = 'hot'").first()["n"] == 3


def test_one_status_key(spark):
    log = spark.range(5_000).select(
        F.lit("hot").alias("job_id"), F.col("id").cast("string").alias("status"), F.lit("s").alias("step"),
        F.lit(1).alias("ts"), F.col("id").alias("event_id"),
    )
    assert outcomes.latest_status(log).collect() == [("hot", "4999", "s")]


def test_one_output_key(spark):
    keys = spark.range(2_000).select(F.when(F.col("id") % 3 == 0, "index.html.txt").otherwise(F.col("id").cast("string")).alias("output_key"))
    assert jobs.key_collisions(keys).collect() == [("index.html.txt", 667)]


def test_long_and_short_documents_are_analysed_alike(spark, monkeypatch):
    rows = [(d, n, f"line {n} the {w} cat\n| und | {w}\n") for d, w in ((None, "zebra"), (1, "apple"), (2, "")) for n in range(5 if d == 1 else 40)]
    parts = spark.createDataFrame(rows + [(3, 0, None), (3, 1, "a lone tail")], "doc_id long, part_no long, text string")
    got = {}
    for most in (1 << 13, 10, 0):  # none is long, two are, all are
        monkeypatch.setattr(analyze, "WHOLE_PARTS", most)
        found = analyze.analyze_parts(parts)
        got[most] = sorted(map(str, found.collect()))
        words_move = "Generate explode" in found._jdf.queryExecution().optimizedPlan().toString()
        assert words_move == (most < 40)  # the words of short documents are never rows
    assert got[1 << 13] == got[10] == got[0] and len(got[0]) == 4
