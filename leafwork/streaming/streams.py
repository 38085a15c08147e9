"""Continuous forms: the same operators on unbounded input.

All sinks are checkpointed. Micro-batch outputs go to a folder named after the
batch and are overwritten if a batch is replayed, so nothing is stored twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafwork import constants as C
from leafwork.operators import jobs as J
from leafwork.operators.outputs import finished_events
from leafwork.plans.converters import convert_documents
from leafwork.sources.writers import move_objects


def jobs_stream(messages: DataFrame, value: str = "value") -> DataFrame:
    """Messages to checked jobs; rejects are rows with an error."""
    checked = J.route_converter(J.validate_jobs(J.parse_jobs(messages, value)))
    return checked.withColumn("rejected", F.col("error").isNotNull())


def start_jobs_stream(
    messages: DataFrame, table: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Land jobs in a table split by ``rejected``: one folder of jobs, one of
    rejects. Each message is handled once; rejects are kept, not retried."""
    writer = (
        jobs_stream(messages)
        .writeStream.format("parquet")
        .partitionBy("rejected")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(table)


def dedupe_stream(jobs: DataFrame, event_time: str, within: str = "1 hour") -> DataFrame:
    """Drop repeats of a job id that arrive within the given time."""
    return jobs.withWatermark(event_time, within).dropDuplicatesWithinWatermark(["job_id"])


def start_folder_watch(
    documents: DataFrame,
    results_table: str,
    checkpoint: str,
    archive_base: str | None = None,
    output_prefix: str = C.CONVERTED_PREFIX,
    types: list[str] | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Convert new files as they appear; ``documents`` comes from
    ``stream_documents``. Files already handled are known from the checkpoint; one of
    unknown type is a failed row.
    Name the document ``types`` if the stream is limited to some, so that a
    micro-batch is read once.

    Each micro-batch is stored before anything is moved, and moves are planned
    from what was stored: only successes move, and a replay finds them done.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        stored = f"{results_table}/batch_id={batch_id}"
        known = ["error"] if "error" in batch.columns else []
        rows = batch.select(F.col("key").alias("doc_id"), "document_type", "content", *known)
        converted = convert_documents(rows, types).select(
            F.col("doc_id").alias("key"),
            J.watch_job_id(F.col("doc_id")).alias("job_id"),
            "document_type",
            F.col("error").isNull().alias("success"),
            F.when(F.col("error").isNull(), J.watch_key(F.col("doc_id"), output_prefix)).alias(
                "output_key"
            ),
            "total_chars",
            "error",
            "text",
        )
        converted.write.mode("overwrite").parquet(stored)
        if archive_base is not None:
            moves = (
                batch.sparkSession.read.parquet(stored)
                .where(F.col("success"))
                .select(
                    F.col("key").alias("source_key"),
                    J.archive_key(F.col("key")).alias("dest_key"),
                )
            )
            move_objects(moves, archive_base).write.mode("overwrite").parquet(
                f"{results_table}_moves/batch_id={batch_id}"
            )

    writer = documents.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def start_latest_status(
    log: DataFrame, table: str, checkpoint: str, job_id: str = "job_id", available_now: bool = False
) -> StreamingQuery:
    """Keep the newest status per job; each micro-batch stores the jobs it
    changed. ``current_status`` reads the table."""
    newest = F.max_by(F.struct("status", "step"), F.struct("ts", "event_id")).alias("s")
    state = log.groupBy(job_id).agg(newest).select(job_id, "s.status", "s.step")

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    writer = (
        state.writeStream.outputMode("update")
        .foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def current_status(changes: DataFrame, job_id: str = "job_id") -> DataFrame:
    """Latest row per job from the stored changes."""
    newest = F.max_by(F.struct("status", "step"), F.col("batch_id")).alias("s")
    return changes.groupBy(job_id).agg(newest).select(job_id, "s.status", "s.step")


def lifecycle_stream(results: DataFrame) -> DataFrame:
    """Completed and failed events of finished jobs, as they finish."""
    return finished_events(results)


def step_outcomes(
    started: DataFrame, finished: DataFrame, limit: str = C.CONVERT_STEP_LIMIT, late: str = "1 hour"
) -> DataFrame:
    """Started steps (job_id, ts, ...) with how they ended, from finished ones (job_id, ts,
    success): completed or failed if that came within ``limit`` of the start, else overdue.

    On streams an outer join under watermarks: events may come up to ``late`` after newer
    ones, a step is told to be overdue once no timely end can come any more, and state is
    dropped then. A job that ends twice in time has two rows. Works on tables just so.
    """
    time = F.col("ts").cast("timestamp")
    begun = started.withColumns({"_job": F.col("job_id"), "started_at": time}).drop("job_id", "ts").withWatermark("started_at", late)
    ended = finished.select(
        "job_id", time.alias("finished_at"), F.coalesce("success", F.lit(False)).alias("_ok")
    ).withWatermark("finished_at", late)
    timely = F.expr(
        f"_job = job_id AND finished_at >= started_at AND finished_at <= started_at + INTERVAL {limit}"
    )
    outcome = F.when(F.col("_ok").isNull(), "overdue").when(F.col("_ok"), "completed").otherwise("failed")
    others = [c for c in started.columns if c not in ("job_id", "ts")]
    return begun.join(ended, timely, "left_outer").select(
        F.col("_job").alias("job_id"), *others, "started_at", "finished_at", outcome.alias("outcome")
    )


def start_step_outcomes(
    started: DataFrame, finished: DataFrame, table: str, checkpoint: str, available_now: bool = False, **limits: str
) -> StreamingQuery:
    """Append ``step_outcomes`` of two streams to a table, each row once."""
    writer = (
        step_outcomes(started, finished, **limits)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(table)
