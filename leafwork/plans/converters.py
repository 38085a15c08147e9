"""Which converter handles which document type.

A row converter is an expression from bytes to the ordered text chunks of a
document; all of them are evaluated in one projection over the documents. A
frame converter is a DataFrame function for types that cannot be expressed so.
Adding a type means adding an entry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork import constants as C
from leafwork.functions import content as B
from leafwork.functions import text as T
from leafwork.functions.csv import csv_records
from leafwork.functions.html import html_text
from leafwork.operators.office import OFFICE_TYPES, office_text, unpack_office

CONVERTED = ["document_type", "text", "total_chars", "pages_processed", "error"]


def _html_chunks(content: Column) -> Column:
    return F.filter(T.text_chunks(html_text(B.utf8_text(content))), lambda c: ~T.is_blank(c))


def _plain_chunks(content: Column) -> Column:
    return T.text_chunks(B.decode_text(content))


def _csv_chunks(content: Column) -> Column:
    n = F.lit(C.SHEET_ROWS_PER_CHUNK)

    def batches(records: Column) -> Column:
        starts = F.when(F.size(records) > 0, F.sequence(F.lit(1), F.size(records), n)).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(
            starts,
            lambda s: F.concat(F.array_join(F.slice(records, s, n), "\n"), F.lit("\n")),
        )

    return T.let(csv_records(B.utf8_text(content)), batches)


def _office_frame(documents: DataFrame) -> DataFrame:
    return office_text(unpack_office(documents))


ROW_CONVERTERS: dict[str, Callable[[Column], Column]] = {
    "html": _html_chunks,
    "txt": _plain_chunks,
    "csv": _csv_chunks,
}
FRAME_CONVERTERS: dict[tuple[str, ...], Callable[[DataFrame], DataFrame]] = {
    tuple(OFFICE_TYPES): _office_frame,
}


def convert_documents(documents: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(doc_id, document_type, content[, error]) to text with counts.

    One row per document, also for those that fail: an unknown type, missing
    bytes, a damaged archive or an earlier ``error`` ends in the error column.
    Row converters run in one pass; each frame converter sees only its types.
    ``types`` names the types that can occur; frame converters of other types
    then stay out of the plan and do not scan the input.
    """
    if "error" not in documents.columns:
        documents = documents.withColumn("error", F.lit(None).cast("string"))
    documents = documents.select("doc_id", "document_type", "content", "error")
    frames = {
        kinds: convert
        for kinds, convert in FRAME_CONVERTERS.items()
        if types is None or set(kinds) & set(types)
    }
    framed = [kind for kinds in frames for kind in kinds]
    if not framed:
        return _convert_rows(documents)
    for_frame = F.coalesce(
        F.col("document_type").isin(framed) & F.col("error").isNull(), F.lit(False)
    )
    converted = _convert_rows(documents.where(~for_frame))
    for kinds, convert in frames.items():
        own = documents.where(for_frame & F.col("document_type").isin(list(kinds)))
        converted = converted.unionByName(convert(own).select("doc_id", *CONVERTED))
    return converted


def _convert_rows(documents: DataFrame) -> DataFrame:
    kind = F.col("document_type")
    error = F.coalesce(
        F.col("error"),
        F.when(
            ~F.coalesce(kind.isin(list(ROW_CONVERTERS)), F.lit(False)),
            F.concat(F.lit("Unsupported document type: "), F.coalesce(kind, F.lit(""))),
        ),
        F.when(F.col("content").isNull(), F.lit("File not found")),
    )
    chunks = F.when(F.lit(False), F.array().cast("array<string>"))
    for name, convert in ROW_CONVERTERS.items():
        chunks = chunks.when(F.col("error").isNull() & (kind == name), convert(F.col("content")))
    return (
        documents.withColumn("error", error)
        .select("doc_id", "document_type", "error", chunks.alias("_chunks"))
        .withColumn("text", F.array_join("_chunks", ""))
        .select(
            "doc_id",
            "document_type",
            "text",
            F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("total_chars"),
            F.greatest(F.size("_chunks"), F.lit(0)).cast("long").alias("pages_processed"),
            "error",
        )
    )
