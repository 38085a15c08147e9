"""Plan shape: what must and must not appear in the physical plans."""

import pytest
from pyspark.sql import functions as F

from leafwork.operators import analyze, outcomes
from leafwork.workload import inputs as I
from leafwork.workload.queries import QUERIES

ARCHIVE_QUERIES = {  # the one step with Python on executors is opening archives
    "docx_to_text", "xlsx_to_text", "pptx_to_text", "odt_to_text", "unpack_office",
    "convert_documents", "folder_watch", "folder_watch_summary",
}
STREAMS_AND_STORES = {
    "jobs_stream", "latest_status_stream", "folder_watch_stream", "read_documents", "fetch_objects",
    "write_text", "write_pages", "move_objects", "delete_objects", "dedupe_stream", "read_parts", "scan_changes",
    "latest_status_levels", "dedupe_runs", "step_outcomes",
}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS_AND_STORES))
def test_no_cross_joins_and_no_row_udfs(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    if name not in ARCHIVE_QUERIES:
        assert "MapInArrow" not in plan and "MapInPandas" not in plan


@pytest.mark.parametrize("name", ["text_stats", "top_words", "language_hint", "analyze_text"])
def test_analytics_do_not_shuffle(spark, sf_dir, name):
    """Apart from handing a small file to all cores."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    plan = plan_of(getattr(analyze, name)(docs).drop("text"))
    assert "Exchange" not in plan and "Window" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_text_is_tokenised_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert plan_of(analyze.analyze_text(docs).drop("text")).count("regexp_extract_all") == 1


@pytest.mark.parametrize("name", ["html_to_text", "csv_to_text", "chunk_text", "split_pages"])
def test_exploded_arrays_are_computed_once(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "Filter (size(" not in plan and "Filter ((size(" not in plan


def test_settled_documents_skip_the_join(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", F.lit("pdf").alias("document_type"), "text", F.col("n_chars").alias("total_chars")
    )
    plan = plan_of(outcomes.best_extraction(docs, docs.drop("document_type")))
    # One join for the choice; before it the enhanced texts are filtered by id.
    assert plan.count("Join") == 2 and plan.count("LeftSemi") == 1 and "n_chars" in plan.split("PushedFilters", 1)[1][:400]


def test_small_inputs_are_spread_and_large_ones_left_alone(spark, sf_dir):
    assert "RoundRobin" in plan_of(I.table(spark, sf_dir, "documents"))
    many = spark.range(0, 1000, 1, 64)
    from leafwork.sources.readers import spread_small

    assert "RoundRobin" not in plan_of(spread_small(many))


def test_counts_combine_before_the_shuffle(spark, sf_dir):
    for name in ("status_summary", "prefix_counts", "batch_progress", "latest_status", "dedupe_jobs"):
        plan = plan_of(QUERIES[name](spark, sf_dir))
        assert "partial_" in plan and "Window" not in plan


def test_listing_does_not_read_contents(spark, tmp_path):
    from leafwork.sources.readers import list_files

    (tmp_path / "a.txt").write_text("x")
    plan = plan_of(list_files(spark, str(tmp_path)))
    assert "content" not in plan.split("ReadSchema", 1)[1]


def test_converted_text_is_not_joined(spark, sf_dir):
    """Contents are joined to their jobs before conversion; texts never after."""
    from leafwork.plans import flows
    from leafwork.workload.queries import QUERIES as registered, _stored_jobs

    plan = plan_of(flows.convert_batch(*_stored_jobs(spark, sf_dir), I.OUTPUT_BUCKET))
    above_conversion = plan.split("Union", 1)[0]
    assert "Join" not in above_conversion and "Exchange" not in above_conversion
    # With the types known no archive is opened; the conversion is where records are read.
    plan = plan_of(registered["convert_batch"](spark, sf_dir))
    above_conversion = plan.split("regexp_extract_all", 1)[0]
    assert "MapInArrow" not in plan and "Join" not in above_conversion and "Exchange" not in above_conversion


def test_results_are_converted_once_for_all_events(spark, sf_dir):
    from leafwork.operators import outputs

    results = I.event_results(spark, sf_dir)
    assert plan_of(outputs.finished_events(results)).count("FileScan") == 1
