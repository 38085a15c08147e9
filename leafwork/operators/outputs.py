"""What is written for a document: pages, metadata JSON, lifecycle events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork import constants as C
from leafwork.functions import text as T
from leafwork.operators import jobs as J
from leafwork.operators.analyze import ANALYTICS
from leafwork.operators.extract import explode_once
from leafwork.operators.parts import part_pages


def split_pages(
    documents: DataFrame,
    text: str = "text",
    job_id: str | None = None,
    prefix: str = C.MULTI_PREFIX,
) -> DataFrame:
    """One row per non-blank page, renumbered from 1. Row-local.

    With ``job_id`` each page also gets the key it is stored under.
    """
    rows = explode_once(documents, T.page_texts(F.col(text)), "page_no", text, 1)
    if job_id is None:
        return rows
    return rows.withColumn("page_key", J.page_key(F.col(job_id), F.col("page_no"), prefix))


def split_part_pages(
    parts: DataFrame, doc_id: str = "doc_id", part_no: str = "part_no", text: str = "text"
) -> DataFrame:
    """``split_pages`` for documents stored in several parts, cut anywhere."""
    return part_pages(parts, doc_id, part_no, text)


def page_uris(job_id: Column, page_count: Column, bucket: Column, prefix: str = C.MULTI_PREFIX) -> Column:
    """``page_1 -> s3://...`` for the pages of one document."""
    numbers = F.when(page_count > 0, F.sequence(F.lit(1), page_count)).otherwise(
        F.array().cast("array<int>")
    )
    return F.map_from_entries(
        F.transform(
            numbers,
            lambda i: F.struct(
                F.concat(F.lit("page_"), i.cast("string")),
                J.object_uri(bucket, J.page_key(job_id, i, prefix)),
            ),
        )
    )


def metadata_json(
    analyzed: DataFrame, generated_at: str | Column, text_output_key: Column
) -> DataFrame:
    """Add ``metadata``: the JSON document stored beside the text."""
    stamp = generated_at if isinstance(generated_at, Column) else F.lit(generated_at)
    return analyzed.withColumn(
        "metadata",
        F.to_json(
            F.struct(
                F.col("job_id"),
                F.col("document_type"),
                stamp.alias("generated_at"),
                text_output_key.alias("text_output_key"),
                F.struct(*ANALYTICS).alias("analytics"),
            )
        ),
    )


def _payload(name: str, fields: list[str]) -> Column:
    return F.to_json(F.struct(F.lit(name).alias("event"), *fields))


def started_events(jobs: DataFrame) -> DataFrame:
    fields = ["job_id", "document_type", "location_type"]
    name = "conversion.started"
    return jobs.select(
        F.lit(name).alias("event"), *fields, _payload(name, fields).alias("payload")
    )


def finished_events(
    results: DataFrame, on_complete: bool = True, on_failure: bool = True
) -> DataFrame | None:
    """A completed or failed event per result, in one pass over the results."""
    if not (on_complete or on_failure):
        return None
    ok = F.coalesce(F.col("success"), F.lit(False))
    completed = ["job_id", "output_bucket", "output_key", "total_chars", "pages_processed"]
    failed = ["job_id", "error"]
    if not on_failure:
        results = results.where(ok)
    elif not on_complete:
        results = results.where(~ok)
    return results.select(
        F.when(ok, "conversion.completed").otherwise("conversion.failed").alias("event"),
        "job_id",
        *[F.when(ok, F.col(c)).alias(c) for c in completed[1:]],
        F.when(~ok, F.col("error")).alias("error"),
        F.when(ok, _payload("conversion.completed", completed))
        .otherwise(_payload("conversion.failed", failed))
        .alias("payload"),
    )


def lifecycle_events(
    jobs: DataFrame,
    results: DataFrame,
    on_start: bool = True,
    on_complete: bool = True,
    on_failure: bool = True,
) -> DataFrame:
    """Outbox rows with a JSON payload; a stage without a target adds nothing."""
    finished = finished_events(results, on_complete, on_failure)
    if not on_start:
        if finished is None:
            raise ValueError("no event target is configured")
        return finished
    started = started_events(jobs)
    return (
        started if finished is None else started.unionByName(finished, allowMissingColumns=True)
    )


def flow_completed_events(documents: DataFrame) -> DataFrame:
    """Completion payload of the document flow."""
    return documents.select(
        "job_id",
        F.to_json(
            F.struct(
                F.col("job_id"),
                F.lit("completed").alias("status"),
                F.col("text_key"),
                F.col("metadata_key"),
                F.col("total_chars"),
            )
        ).alias("payload"),
    )
