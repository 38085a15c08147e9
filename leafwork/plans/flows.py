"""End-to-end jobs as compositions of the operators.

Every function returns lazy DataFrames. A stage that is switched off is not
added to the plan, so its columns are never computed.
"""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork import constants as C
from leafwork.functions import text as T
from leafwork.functions.paths import or_default
from leafwork.operators import analyze, files, jobs, outcomes, outputs
from leafwork.plans.converters import convert_documents
from leafwork.sources.readers import fetch_documents, list_files, wanted_documents
from leafwork.sources.writers import write_table


def convert_batch(
    accepted: DataFrame, documents: DataFrame, default_bucket: str, types: list[str] | None = None
) -> DataFrame:
    """Jobs to converted text and result columns, one row per job.

    ``accepted`` comes from ``validate_jobs``; rows that already carry an error
    pass through as failures. ``documents`` holds (key, content). ``types``, if
    known, are the only ones that jobs ask for: see ``convert_documents``.
    """
    # Where the text goes travels inside the id, so the converted text is never
    # joined to anything.
    target = F.struct(
        F.col("job_id"),
        or_default(F.col("output_s3_bucket"), F.lit(default_bucket)).alias("output_bucket"),
        jobs.text_key(F.col("job_id"), F.col("output_s3_key")).alias("output_key"),
    )
    fetched = fetch_documents(accepted, documents)
    converted = convert_documents(
        fetched.select(target.alias("doc_id"), "document_type", "content", "error"), types
    )
    ok = F.col("error").isNull()
    return converted.select(
        F.col("doc_id.job_id").alias("job_id"),
        ok.alias("success"),
        F.when(ok, F.col("doc_id.output_bucket")).alias("output_bucket"),
        F.when(ok, F.col("doc_id.output_key")).alias("output_key"),
        "error",
        "pages_processed",
        F.col("total_chars").alias("characters_extracted"),
        "text",
    )


def document_flow(
    documents: DataFrame,
    generated_at: str | Column,
    prefix: str = C.FLOW_PREFIX,
    max_mb: float | None = None,
    enable_validation: bool = True,
    enable_analytics: bool = True,
    enable_metadata: bool = True,
    language_mode: str = "compat",
    types: list[str] | None = None,
) -> DataFrame:
    """Validate, convert, analyse and describe (job_id, document_type, content).

    One row per document; ``metadata`` needs the analytics stage. ``types``, if
    known, are the only ones there are: see ``convert_documents``.
    """
    rows = documents.withColumnRenamed("job_id", "doc_id")
    if enable_validation:
        rows = files.validate_document(rows, max_mb=max_mb).withColumn(
            "error", F.concat(F.lit("Validation failed: "), F.col("validation_error"))
        )
    flow = convert_documents(rows, types).withColumnRenamed("doc_id", "job_id")
    ok = F.col("error").isNull()
    flow = flow.withColumns(
        {
            "success": ok,
            "text_key": F.when(ok, jobs.flow_key(F.col("job_id"), "text.txt", prefix)),
        }
    )
    if enable_analytics:
        flow = analyze.analyze_text(flow.drop("total_chars"), language_mode=language_mode)
        if enable_metadata:
            flow = outputs.metadata_json(flow, generated_at, F.col("text_key"))
            meta_key = jobs.flow_key(F.col("job_id"), "metadata.json", prefix)
            flow = flow.withColumns(
                {
                    "metadata": F.when(ok, F.col("metadata")),
                    "metadata_key": F.when(ok, meta_key),
                }
            )
    return flow


def multi_format_output(
    documents: DataFrame,
    bucket: str,
    generated_at: str | Column,
    prefix: str = C.MULTI_PREFIX,
    full_text: bool = True,
    pages: bool = True,
    metadata: bool = True,
    analytics: bool = True,
    language_mode: str = "compat",
) -> DataFrame:
    """Every output of a converted document (job_id, document_type, text).

    Row-local. ``pages`` maps page names to where they are stored; the page
    texts themselves come from ``split_pages``.
    """
    job, store = F.col("job_id"), F.lit(bucket)
    made = ["job_id"]
    out = documents.select("job_id", "document_type", "text")
    text_uri = (
        jobs.object_uri(store, jobs.flow_key(job, "full_text.txt", prefix))
        if full_text
        else F.lit("")
    )
    if full_text:
        out = out.withColumn("full_text", text_uri)
        made.append("full_text")
    if pages:
        out = out.withColumn("_n", F.size(T.page_texts(F.col("text"))))
        out = out.withColumn("pages", outputs.page_uris(job, F.col("_n"), store, prefix))
        made.append("pages")
    if analytics:
        out = analyze.analyze_text(out, language_mode=language_mode).withColumn(
            "analytics",
            F.struct(
                "total_words",
                "total_pages",
                F.col("language_hint").alias("language"),
                "has_tables",
                "has_images",
                "top_words",
            ),
        )
        made.append("analytics")
        if metadata:
            out = outputs.metadata_json(out, generated_at, text_uri).withColumn(
                "metadata_uri", jobs.object_uri(store, jobs.flow_key(job, "metadata.json", prefix))
            )
            made += ["metadata", "metadata_uri"]
    return out.select(*made)


class WatchRun(NamedTuple):
    results: DataFrame
    moves: DataFrame
    summary: DataFrame


def folder_watch(
    listing: DataFrame,
    documents: DataFrame,
    max_files: int | None = None,
    output_prefix: str = C.CONVERTED_PREFIX,
    processed_prefix: str | None = C.PROCESSED_PREFIX,
    results_table: str | None = None,
) -> WatchRun:
    """Scan a folder, convert what was found, plan the moves, sum up.

    ``listing`` has keys and sizes, ``documents`` (key, content). The three
    results come from one conversion: give a ``results_table`` to run it once
    and store the texts there; without it each result runs it when used.
    """
    found = files.scan_inbox(listing, max_files)
    typed = found.where(F.col("document_type") != "")
    inputs = typed.select("key", "document_type").join(
        wanted_documents(documents, typed), "key", "left"
    )
    converted = convert_documents(
        inputs.select(F.col("key").alias("doc_id"), "document_type", "content")
    ).withColumnRenamed("doc_id", "key")
    if results_table is not None:
        write_table(
            converted.withColumn("job_id", jobs.watch_job_id(F.col("key"))),
            results_table,
            mode="overwrite",
        )
        converted = listing.sparkSession.read.parquet(results_table)
    ok = F.col("error").isNull()
    results = converted.select(
        "key",
        ok.alias("success"),
        F.when(ok, jobs.watch_key(F.col("key"), output_prefix)).alias("output_key"),
        "total_chars",
        "error",
    )
    moves = files.archive_processed(
        results if processed_prefix is not None else results.where(F.lit(False)),
        processed_prefix or "",
    )
    summary = outcomes.watch_summary(found, results)
    return WatchRun(results, moves, summary)


def retry_escalation(
    standard: DataFrame,
    enhanced: DataFrame,
    default_bucket: str,
    threshold: int = C.MIN_CHARS_THRESHOLD,
) -> DataFrame:
    """The better extraction of each document and where it is stored."""
    best = outcomes.best_extraction(standard, enhanced, threshold)
    return best.withColumns(
        {
            "output_bucket": F.lit(default_bucket),
            "output_key": jobs.text_key(F.col("doc_id").cast("string")),
        }
    )


def conversion_with_events(
    accepted: DataFrame,
    documents: DataFrame,
    default_bucket: str,
    on_start: bool = True,
    on_complete: bool = True,
    on_failure: bool = True,
    types: list[str] | None = None,
) -> DataFrame:
    """``convert_batch`` told as lifecycle events."""
    results = convert_batch(accepted, documents, default_bucket, types).withColumnRenamed(
        "characters_extracted", "total_chars"
    )
    return outputs.lifecycle_events(accepted, results, on_start, on_complete, on_failure)


def maintenance(
    listing: DataFrame, now: dt.datetime | Column, max_age_hours: int = C.RETENTION_HOURS
) -> DataFrame:
    """What a cleanup run would free; ``files.expired`` names the files."""
    return files.retention_report(listing, now, max_age_hours)


def folder_maintenance(
    spark: SparkSession,
    base: str,
    now: dt.datetime | Column,
    max_age_hours: int = C.RETENTION_HOURS,
) -> DataFrame:
    """``maintenance`` of a folder, with the errors met; a folder that is not
    there is an error in the report."""
    try:
        listing = list_files(spark, base)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.range(1).select(
            F.lit(0).cast("long").alias("files_deleted"),
            F.lit(0).cast("long").alias("bytes_freed"),
            F.array(F.lit("Directory not found")).alias("errors"),
        )
    return maintenance(listing, now, max_age_hours).withColumn(
        "errors", F.array().cast("array<string>")
    )
