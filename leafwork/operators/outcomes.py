"""Outcome tables: choices, results, progress, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork import constants as C


def best_extraction(
    standard: DataFrame,
    enhanced: DataFrame,
    threshold: int = C.MIN_CHARS_THRESHOLD,
    doc_id: str = "doc_id",
) -> DataFrame:
    """Keep the standard text or the enhanced one.

    Both inputs hold (doc_id, text, total_chars); ``standard`` also has
    document_type. Only documents that fall below the threshold take part in
    the join; all others pass straight through without a shuffle, and enhanced
    texts nobody asks for are filtered by id before they move.
    """
    short = (F.col("total_chars") < threshold) & F.col("document_type").isin(C.ESCALATION_TYPES)
    escalate = F.coalesce(short, F.lit(False))
    settled = standard.where(~escalate).select(
        doc_id,
        "document_type",
        "text",
        "total_chars",
        F.lit(False).alias("escalated"),
        F.lit(1).cast("long").alias("attempt"),
        F.lit("standard").alias("chosen"),
    )
    asked = standard.where(escalate).select(doc_id)
    other = enhanced.join(asked, doc_id, "left_semi").select(
        doc_id,
        F.col("text").alias("_enhanced_text"),
        F.col("total_chars").alias("_enhanced_chars"),
    )
    better = F.coalesce(F.col("_enhanced_chars") > F.col("total_chars"), F.lit(False))
    retried = (
        standard.where(escalate)
        .join(other, doc_id, "left")
        .select(
            doc_id,
            "document_type",
            F.when(better, F.col("_enhanced_text")).otherwise(F.col("text")).alias("text"),
            F.when(better, F.col("_enhanced_chars"))
            .otherwise(F.col("total_chars"))
            .alias("total_chars"),
            F.lit(True).alias("escalated"),
            F.lit(2).cast("long").alias("attempt"),
            F.when(better, "enhanced").otherwise("standard").alias("chosen"),
        )
    )
    return settled.unionByName(retried)


def _watch_key(results: DataFrame) -> str:
    return "key" if "key" in results.columns else "job_id"


def watch_results(files: DataFrame, results: DataFrame) -> DataFrame:
    """One row per converted file. The sides meet on ``key``, as two keys may map to
    one job id; on ``job_id`` only where results do not carry the key."""
    by = _watch_key(results)
    return files.select(*{by, "key"}).join(results.drop(*{"job_id", "key"} - {by}), by).select(
        "key", "success", "output_key", "total_chars", "error"
    )


def watch_summary(files: DataFrame, results: DataFrame) -> DataFrame:
    """Scanned, converted and failed; a file of unknown type counts as failed
    and so does one whose conversion left no result."""
    by = _watch_key(results)
    outcome = files.select(by, "document_type").join(results.select(by, "success"), by, "left")
    converted = F.coalesce(F.col("success") & (F.col("document_type") != ""), F.lit(False))
    return outcome.agg(
        F.count(F.lit(1)).alias("total_scanned"),
        F.count_if(converted).alias("total_converted"),
        F.count_if(~converted).alias("total_failed"),
    )


def batch_progress(results: DataFrame, batch: str = "batch_id") -> DataFrame:
    return results.groupBy(batch).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("success")).alias("completed"),
        F.count_if(~F.coalesce(F.col("success"), F.lit(False))).alias("failed"),
    )


def status_summary(runs: DataFrame, kind: str = "workflow_type") -> DataFrame:
    """Runs per type with one total row. The total rolls up the per-type
    counts, so the big table is expanded by nothing."""
    measures = ["executions", "completed", "failed", "running"]
    per_kind = runs.groupBy(kind).agg(
        F.count(F.lit(1)).alias("executions"),
        *[F.count_if(F.col("status") == m.upper()).alias(m) for m in measures[1:]],
    )
    return per_kind.rollup(kind).agg(
        F.grouping_id().cast("long").alias("is_total"), *[F.sum(m).alias(m) for m in measures]
    )


def recent_jobs(runs: DataFrame, limit: int = C.RECENT_JOBS_LIMIT) -> DataFrame:
    """Newest runs first: each task keeps ``limit`` rows."""
    return (
        runs.select("id", "run_id", "status", "workflow_type", "start_time", "close_time")
        .orderBy(F.col("start_time").desc(), F.col("id"))
        .limit(limit)
    )


def latest_status(log: DataFrame, job_id: str = "job_id") -> DataFrame:
    """Current status and step per job; the newest entry wins."""
    newest = F.max_by(F.struct("status", "step"), F.struct("ts", "event_id")).alias("s")
    return log.groupBy(job_id).agg(newest).select(job_id, "s.status", "s.step")
