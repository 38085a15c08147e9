"""File listings: discover, check, archive and age them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork import constants as C
from leafwork.functions.content import sniff_mime as sniff_mime_expr
from leafwork.functions.paths import document_type_of, extension
from leafwork.functions.paths import url_extension as url_extension_expr
from leafwork.operators.jobs import archive_key


def infer_doc_type(files: DataFrame, key: str = "key") -> DataFrame:
    """Add the lower-case extension and the document type it stands for."""
    return files.withColumn("ext", F.lower(extension(F.col(key)))).withColumn(
        "document_type", document_type_of(F.col("ext"))
    )


def url_extension(rows: DataFrame, url: str = "url") -> DataFrame:
    return rows.withColumn("ext", url_extension_expr(F.col(url)))


def _listed(files: DataFrame) -> DataFrame:
    return infer_doc_type(files.where(~F.endswith(F.col("key"), F.lit("/"))))


def _allowed(extensions: list[str]) -> Column:
    return F.col("ext").isin([e.lower() for e in extensions])


def scan_inbox(
    files: DataFrame,
    max_files: int | None = None,
    extensions: list[str] = C.SCAN_EXTENSIONS,
) -> DataFrame:
    """All convertible keys, or the first ``max_files`` in byte order (at least one)."""
    wanted = _listed(files).where(_allowed(extensions))
    if max_files is None:
        return wanted
    return wanted.orderBy("key").limit(max(max_files, 1))


def scan_summary(
    files: DataFrame,
    max_files: int | None = None,
    extensions: list[str] = C.SCAN_EXTENSIONS,
) -> DataFrame:
    """One row: files found, and files skipped (with a cap: before it was reached).

    The last key kept bounds what was visited; it enters as a scalar subquery,
    so skipped keys are counted in parallel without ordering them.
    """
    if max_files is None:
        allowed = F.coalesce(_allowed(extensions), F.lit(False))
        return _listed(files).agg(
            F.count_if(allowed).alias("total_found"), F.count_if(~allowed).alias("skipped")
        )
    cap = max(max_files, 1)
    kept = scan_inbox(files, max_files, extensions)
    found = kept.agg(F.count(F.lit(1)).alias("n"))
    last = kept.agg(F.max("key").alias("last_key"))
    skipped = (
        _listed(files)
        .where(~_allowed(extensions))
        .where((found.scalar() < cap) | (F.col("key") < last.scalar()))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    one_row = files.sparkSession.range(1)
    return one_row.select(
        found.scalar().alias("total_found"), skipped.scalar().alias("skipped")
    )


def max_bytes(max_mb: float) -> int:
    return int(max_mb * 1024 * 1024)


def validate_document(
    documents: DataFrame,
    content: str = "content",
    size: Column | None = None,
    max_mb: float | None = None,
) -> DataFrame:
    """Add ``valid``, ``file_size_bytes``, ``mime_type`` and ``validation_error``.

    There is no size limit unless one is given; a size exactly at the limit is
    fine; the media type never rejects.
    """
    limit = None if max_mb is None else max_bytes(max_mb)
    body = F.col(content)
    n = F.octet_length(body).cast("long") if size is None else size.cast("long")
    sized = documents.withColumn("file_size_bytes", F.coalesce(n, F.lit(0).cast("long")))
    n = F.col("file_size_bytes")
    error = (
        F.when(body.isNull(), F.lit("File not found"))
        .when(
            F.lit(False) if limit is None else n > limit,
            F.concat(
                F.lit("File too large: "), n.cast("string"), F.lit(f" bytes (max {limit})")
            ),
        )
        .when(n == 0, F.lit("File is empty"))
    )
    return (
        sized.withColumn("validation_error", error)
        .withColumn("valid", F.col("validation_error").isNull())
        .withColumn(
            "mime_type",
            F.when(F.col("valid"), sniff_mime_expr(body.cast("binary"))).otherwise(""),
        )
    )


def sniff_mime(documents: DataFrame, content: str = "content") -> DataFrame:
    return documents.withColumn("mime_type", sniff_mime_expr(F.col(content).cast("binary")))


def archive_processed(results: DataFrame, prefix: str = C.PROCESSED_PREFIX) -> DataFrame:
    """Moves to make: sources whose conversion succeeded, and where they go."""
    return results.where(F.col("success")).select(
        F.col("key").alias("source_key"), archive_key(F.col("key"), prefix).alias("dest_key")
    )


def expired(
    files: DataFrame, now: dt.datetime | Column, max_age_hours: int = C.RETENTION_HOURS
) -> DataFrame:
    """Files strictly older than the retention period."""
    moment = now if isinstance(now, Column) else F.lit(now)
    cutoff = moment - F.make_dt_interval(hours=F.lit(max_age_hours))
    return files.where(F.col("last_modified") < cutoff)


def retention_report(
    files: DataFrame, now: dt.datetime | Column, max_age_hours: int = C.RETENTION_HOURS
) -> DataFrame:
    """How many files are past retention and how many bytes they hold."""
    return expired(files, now, max_age_hours).agg(
        F.count(F.lit(1)).alias("files_deleted"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("bytes_freed"),
    )


def prefix_counts(files: DataFrame, key: str = "key") -> DataFrame:
    """Objects per first path segment."""
    return files.groupBy(F.substring_index(F.col(key), "/", 1).alias("prefix")).agg(
        F.count(F.lit(1)).alias("objects")
    )
