"""Inputs of the registered queries, derived from the given tables.

The derivations are plain SQL expressions that mean the same in Spark and in
the checking engine, so a query and its check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.sources.readers import spread_small

TEXT_TABLES = ["documents", "pages", "conversations"]
OUTPUT_BUCKET = "texts"
GENERATED_AT = "2024-02-01T00:00:00+00:00"

# --- pages as job messages ---------------------------------------------------
_ID = "CAST(page_id AS STRING)"
MESSAGE = f"""CASE WHEN page_id % 40 = 19
 THEN '{{"job_id":"first","document_type":"html","location_type":"url","url":"' || url || '","job_id":"m' || {_ID} || '"}}'
 WHEN page_id % 40 = 28 THEN '{{"document_type":"html","location_type":"url","url":"' || url || '"}} x}}'
 WHEN page_id % 40 = 37
 THEN '{{"document_type":"html","location_type":"url","url":"' || url || '","auth_token":["a","b"]}}'
 ELSE CASE page_id % 10
 WHEN 0 THEN '{{bad ' || {_ID}
 WHEN 1 THEN '{{"job_id":"m' || {_ID} || '","document_type":"mp3","location_type":"url","url":"' || url || '"}}'
 WHEN 2 THEN '{{"job_id":"m' || {_ID} || '","document_type":"html","location_type":"url"}}'
 WHEN 3 THEN '{{"job_id":"m' || {_ID} || '","document_type":"pdf","location_type":"s3","s3_bucket":"","s3_key":"in/' || {_ID} || '.pdf"}}'
 WHEN 4 THEN '{{"job_id":"m' || {_ID} || '","document_type":"txt","location_type":"local"}}'
 WHEN 5 THEN '{{"document_type":"csv","location_type":"ftp","ftp_host":"files.example.org","ftp_path":"/d/' || {_ID} || '.csv","ftp_port":"2121","ftp_pass":"s3cret","extra":' || {_ID} || '}}'
 WHEN 6 THEN '{{"job_id":"","document_type":"docx","location_type":"s3","s3_bucket":"inbox","s3_key":"in/a/' || {_ID} || '.docx","output_s3_bucket":"out","output_s3_key":"done/' || {_ID} || '.txt"}}'
 WHEN 7 THEN '{{"document_type":"html","location_type":"url","url":"' || url || '","ftp_port":null}}'
 WHEN 8 THEN '{{"location_type":"url","url":"' || url || '"}}'
 ELSE '{{"job_id":"m' || {_ID} || '","document_type":"html","location_type":"url","url":"' || url || '","auth_type":"bearer","auth_token":"t0ken"}}'
 END END"""

# --- pages as messages of one job, of several, of none, and a broken one --------
_JOB = "'{{\"job_id\":\"{0}' || " + _ID + " || '\",\"document_type\":\"html\",\"location_type\":\"url\",\"url\":\"' || url || '\"}}'"
_JOBS = [_JOB.format(n) for n in "abc"]
BATCH_MESSAGE = f"""CASE page_id % 50
 WHEN 0 THEN '[]'
 WHEN 1 THEN '[' || {_JOBS[0]} || ','
 WHEN 2 THEN {_JOBS[0]}
 WHEN 3 THEN '[' || {_JOBS[0]} || ']'
 ELSE '[' || {_JOBS[0]} || ',' || {_JOBS[1]} || ',' || {_JOBS[2]} || ']' END"""

# --- documents as CSV: quoted cells with line breaks and doubled quotes ----------
CSV_TEXT = """'"' || replace(replace(replace(text, ' the ', ' ""the"" '), ', ', '","'), '.' || chr(10),
 '."' || chr(13) || chr(10) || '"') || '"'"""

# --- documents as files in an inbox ------------------------------------------
FILE_KEY = """'inbox/' || source || '/' || CAST(doc_id AS STRING) || CASE doc_id % 12
 WHEN 0 THEN '.pdf' WHEN 1 THEN '.txt' WHEN 2 THEN '.HTML' WHEN 3 THEN '.docx' WHEN 4 THEN '.zip'
 WHEN 5 THEN '.csv' WHEN 6 THEN '' WHEN 7 THEN '.htm' WHEN 8 THEN '.jpeg' WHEN 9 THEN '.tar.gz'
 WHEN 10 THEN '.xlsx' ELSE '/' END"""
FILE_SUCCESS = "doc_id % 7 <> 0"

# --- documents with two extractions ------------------------------------------
EXTRACTION_TYPE = (
    "CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'docx' ELSE 'pdf' END"
)
# Whole texts on both sides: what an extraction misses is blanked, never cut off, and its
# total_chars counts what can be seen.
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_UNREAD = f"translate(text, '{_LETTERS}.,', '{' ' * 54}')"
STANDARD_TEXT = f"CASE WHEN doc_id % 3 = 0 THEN {_UNREAD} ELSE text END"
ENHANCED_TEXT = f"""CASE doc_id % 5 WHEN 0 THEN {_UNREAD} WHEN 1 THEN translate(text, 'aeiou', '     ')
 ELSE text END"""


def visible_chars(text: str) -> str:
    return f"CAST(length(replace(replace({text}, ' ', ''), '\n', '')) AS BIGINT)"


# --- conversation turns as pages ----------------------------------------------
PAGE_NATIVE = "CASE WHEN turn % 4 = 3 OR role = 'system' THEN ' ' ELSE text END"
PAGE_FALLBACK = "CASE WHEN turn % 4 = 3 THEN text ELSE '' END"
FRAME_TEXT = "CASE WHEN turn % 5 = 2 THEN ' ' ELSE text END"

# --- events as a job log -------------------------------------------------------
RUN_STATUS = (
    "CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'COMPLETED' "
    "ELSE 'RUNNING' END"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; text tables get a task per core even if they are small."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread_small(rows) if name in TEXT_TABLES else rows


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, one file or a folder of files, read as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # A stream takes a single file only by a pattern; this one fits nothing else.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.[p]arquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.expr(MESSAGE).alias("value"))


def inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, key, size_bytes, text) of each document as a stored file."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.expr(FILE_KEY).alias("key"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        "text",
    )


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_lines = F.when(F.col("role") == "system", F.array(F.col("text"), F.lit(" ")))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"),
        (F.col("turn") + 1).alias("page_no"),
        F.expr(PAGE_NATIVE).alias("native"),
        F.expr(PAGE_FALLBACK).alias("fallback"),
        F.coalesce(text_lines, F.array().cast("array<string>")).alias("images"),
    )


def frame_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"),
        (F.col("turn") + 1).alias("frame_no"),
        F.expr(FRAME_TEXT).alias("text"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.expr(RUN_STATUS)
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("run-"), F.col("event_id").cast("string")).alias("id"),
        F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("run_id"),
        status.alias("status"),
        F.col("event_type").alias("workflow_type"),
        F.col("ts").alias("start_time"),
        F.when(status != "RUNNING", F.col("ts")).alias("close_time"),
    )


def status_log(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("job_id"),
        F.expr(RUN_STATUS).alias("status"),
        F.col("event_type").alias("step"),
        "ts",
        "event_id",
    )


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.col("event_type"), F.lit("/"), F.col("event_id").cast("string")).alias("key"),
        F.octet_length("props").cast("long").alias("size_bytes"),
        F.col("ts").alias("last_modified"),
    )


def event_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished jobs of the log: errors failed, purchases completed."""
    job = F.concat(F.lit("job-"), F.col("event_id").cast("string"))
    done = F.col("event_type").isin("error", "purchase")
    ok = F.col("event_type") == "purchase"
    return (
        table(spark, sf_dir, "events")
        .where(done)
        .select(
            job.alias("job_id"),
            F.col("user_id").alias("batch_id"),
            ok.alias("success"),
            F.when(ok, F.lit(OUTPUT_BUCKET)).alias("output_bucket"),
            F.when(ok, F.concat(F.lit("converted/"), job, F.lit(".txt"))).alias("output_key"),
            F.octet_length("props").cast("long").alias("total_chars"),
            F.lit(1).cast("long").alias("pages_processed"),
            F.when(~ok, F.concat(F.lit("failed with "), F.col("props"))).alias("error"),
        )
    )


def event_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("job-"), F.col("event_id").cast("string")).alias("job_id"),
        F.when(F.col("user_id") % 2 == 0, "html").otherwise("txt").alias("document_type"),
        F.lit("s3").alias("location_type"),
    )
