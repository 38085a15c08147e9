"""Bytes and extraction rows to text.

Long documents are kept as ordered parts ``(doc_id, part_no, text)``: a part
holds a bounded number of consecutive rows, so no group and no cell grows
without limit. A document that fits one part (the usual case) is one row, and
its parts in order concatenate to exactly its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork import constants as C
from leafwork.functions import content as B
from leafwork.functions import text as T
from leafwork.functions.csv import csv_records
from leafwork.functions.html import html_text

PAGES_PER_PART = 1_000
CHUNKS_PER_PART = 1_000


def explode_once(df: DataFrame, pieces: Column, no: str, value: str, start: int) -> DataFrame:
    """One row per array element with its running number; the array expression
    is evaluated once per row.

    It becomes a column of its own, and the outer form of explode is used: the
    plain form makes the optimizer add a filter on the array's size that pulls
    the whole expression below and runs it again. Rows of empty arrays are
    dropped after the explode instead.
    """
    kept = [c for c in df.columns if c != value]
    prepared = df.select(*kept, pieces.alias("_pieces"))
    exploded = prepared.select(*kept, F.posexplode_outer("_pieces").alias("_pos", value))
    return exploded.where(F.col("_pos").isNotNull()).select(
        *kept, (F.col("_pos") + start).cast("long").alias(no), value
    )


def _block(no: str, size: int, first: int) -> Column:
    """Which run of ``size`` consecutive numbers a row belongs to, from 0."""
    return F.expr(f"(`{no}` - {int(first)}) div {int(size)}")


def chunk_text(
    documents: DataFrame,
    text: str = "text",
    size: int = C.CHUNK_CHARS,
    drop_blank: bool = False,
) -> DataFrame:
    """Fixed-size character chunks, numbered from 0 by their place in the text.

    With ``drop_blank`` white-space-only chunks vanish (HTML and RTF keep none
    of them, plain text keeps all).
    """
    rows = explode_once(documents, T.text_chunks(F.col(text), size), "chunk_no", text, 0)
    return rows.where(~T.is_blank(F.col(text))) if drop_blank else rows


def line_parts(documents: DataFrame, text: str = "text", size: int = 1_000_000) -> DataFrame:
    """Long texts to parts of up to ``size`` characters, cut at line ends only.

    Parts are numbered from 0 and join up to the text; a single longer line
    stays whole. ``analyze_parts`` on them gives what ``analyze_text`` gives on
    the document, without holding all its words in one row.
    """
    pieces = F.regexp_extract_all(
        F.col(text),
        F.lit(f"(?s).{{1,{int(size)}}}(?:(?<=\\n)|\\z)|[^\\n]*+(?:\\n|\\z)"),
        F.lit(0),
    )
    whole = F.when(F.col(text) == "", F.array(F.lit(""))).otherwise(
        F.filter(pieces, lambda p: p != "")
    )
    return explode_once(documents, whole, "part_no", text, 0)


def html_to_text(
    documents: DataFrame, html: str = "html", size: int = C.CHUNK_CHARS
) -> DataFrame:
    """Visible text of each page as chunks."""
    plain = documents.withColumn("text", html_text(F.col(html))).drop(html)
    return chunk_text(plain, "text", size, drop_blank=True)


def decode_text(documents: DataFrame, content: str = "content") -> DataFrame:
    """Plain-text bytes to text with ``\\n`` line ends."""
    return documents.withColumn("text", B.decode_text(F.col(content))).drop(content)


def csv_rows(documents: DataFrame, text: str = "text") -> DataFrame:
    """One row per CSV record, cells joined by `` | ``, numbered from 1."""
    return explode_once(documents, csv_records(F.col(text)), "row_no", text, 1)


def csv_to_text(
    documents: DataFrame, text: str = "text", rows_per_chunk: int = C.SHEET_ROWS_PER_CHUNK
) -> DataFrame:
    """CSV files to chunks of ``rows_per_chunk`` records without a shuffle: a
    file is one cell, so its records are grouped inside the row."""
    records = documents.withColumn("_records", csv_records(F.col(text)))
    n = int(rows_per_chunk)
    starts = F.when(
        F.size("_records") > 0,
        F.sequence(F.lit(1), F.size("_records"), F.lit(n)),
    ).otherwise(F.array().cast("array<int>"))
    chunks = F.transform(
        starts,
        lambda s: F.concat(
            F.array_join(F.slice(F.col("_records"), s, F.lit(n)), "\n"), F.lit("\n")
        ),
    )
    return explode_once(records, chunks, "chunk_no", text, 0).drop("_records")


def batch_rows(
    rows: DataFrame,
    rows_per_chunk: int = C.PARAGRAPHS_PER_CHUNK,
    doc_id: str = "doc_id",
    row_no: str = "row_no",
    text: str = "text",
) -> DataFrame:
    """Consecutive rows (numbered from 1) joined N at a time, one chunk each.

    Groups are (document, chunk), so the largest one has N rows whatever the
    size of the document.
    """
    chunk = _block(row_no, rows_per_chunk, 1)
    ordered = F.sort_array(F.collect_list(F.struct(row_no, text)))
    return (
        rows.groupBy(doc_id, chunk.alias("chunk_no"))
        .agg(ordered.alias("rows"))
        .select(
            doc_id,
            "chunk_no",
            F.concat(F.array_join(F.col(f"rows.{text}"), "\n"), F.lit("\n")).alias(text),
        )
    )


def concat_chunks(
    chunks: DataFrame,
    doc_id: str = "doc_id",
    chunk_no: str = "chunk_no",
    text: str = "text",
    chunks_per_part: int = CHUNKS_PER_PART,
    documents: DataFrame | None = None,
) -> DataFrame:
    """Chunks back to document text, with characters and chunks counted.

    ``pages_processed`` is the number of chunks, as every converter reports it.
    A document without chunks has no row, unless ``documents`` lists all ids:
    each then adds an empty piece to its part 0, which counts as no chunk.
    """
    pieces = chunks.select(doc_id, chunk_no, text, F.lit(1).alias("_chunks"))
    if documents is not None:
        empty = [F.lit(0).cast("long").alias(chunk_no), F.lit("").alias(text), F.lit(0).alias("_chunks")]
        pieces = pieces.unionByName(documents.select(doc_id, *empty))
    part = _block(chunk_no, chunks_per_part, 0)
    ordered = F.sort_array(F.collect_list(F.struct(chunk_no, text)))
    return (
        pieces.groupBy(doc_id, part.alias("part_no"))
        .agg(
            ordered.alias("pieces"),
            F.sum(F.char_length(text)).cast("long").alias("total_chars"),
            F.sum("_chunks").alias("pages_processed"),
        )
        .select(
            doc_id,
            "part_no",
            F.array_join(F.col(f"pieces.{text}"), "").alias(text),
            "total_chars",
            "pages_processed",
        )
    )


def document_totals(parts: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Characters and chunks per document over all its parts (no text moves)."""
    return parts.groupBy(doc_id).agg(
        F.sum("total_chars").alias("total_chars"),
        F.sum("pages_processed").alias("pages_processed"),
    )


def page_text(native: Column, fallback: Column, images: Column) -> Column:
    """Native text, else fallback text, then a line per non-blank image text."""
    blank = F.lit("")
    body = F.coalesce(
        F.nullif(T.strip(native), blank), F.nullif(T.strip(fallback), blank)
    )
    lines = F.transform(
        F.filter(images, lambda t: ~T.is_blank(t)),
        lambda t: F.concat(F.lit(C.IMAGE_MARKER + " "), T.strip(t)),
    )
    none = F.array().cast("array<string>")
    return F.array_join(
        F.concat(
            F.when(body.isNotNull(), F.array(body)).otherwise(none), F.coalesce(lines, none)
        ),
        "\n",
    )


def render_pages(
    pages: DataFrame,
    page_no: str = "page_no",
    native: str = "native",
    fallback: str = "fallback",
    images: str = "images",
) -> DataFrame:
    """Page rows with their marker and text; ``text`` is null for empty pages.
    Row-local: this is the form to use when the pages need not be joined up."""
    body = page_text(F.col(native), F.col(fallback), F.col(images))
    kept = [c for c in pages.columns if c not in (native, fallback, images)]
    return pages.select(*kept, body.alias("_body")).select(
        *kept,
        F.when(
            F.col("_body") != "",
            F.concat(
                F.lit(C.PAGE_MARKER_PREFIX), F.col(page_no).cast("string"), F.lit(" ---\n"),
                F.col("_body"), F.lit("\n"),
            ),
        ).alias("text"),
    )


def assemble_pages(
    pages: DataFrame,
    doc_id: str = "doc_id",
    page_no: str = "page_no",
    pages_per_part: int = PAGES_PER_PART,
    **columns: str,
) -> DataFrame:
    """Page rows (numbered from 1) to document text parts.

    Empty pages leave a gap in the numbers; a document with only empty pages
    keeps a row with empty text.
    """
    rendered = render_pages(pages, page_no, **columns)
    part = _block(page_no, pages_per_part, 1)
    present = F.when(F.col("text").isNotNull(), F.struct(page_no, "text"))
    return (
        rendered.groupBy(doc_id, part.alias("part_no"))
        .agg(
            F.sort_array(F.collect_list(present)).alias("pieces"),
            F.coalesce(F.sum(F.char_length("text")), F.lit(0)).cast("long").alias("total_chars"),
            F.count("text").alias("pages_processed"),
            F.coalesce(F.sum(T.count_substring(F.col("text"), C.IMAGE_MARKER)), F.lit(0))
            .cast("long")
            .alias("images_extracted"),
        )
        .select(
            doc_id,
            "part_no",
            F.array_join(F.col("pieces.text"), "").alias("text"),
            "total_chars",
            "pages_processed",
            "images_extracted",
        )
    )


def assemble_frames(
    frames: DataFrame,
    doc_id: str = "doc_id",
    frame_no: str = "frame_no",
    text: str = "text",
    frames_per_part: int = PAGES_PER_PART,
) -> DataFrame:
    """Frame texts (numbered from 1) to image text; headers only if n > 1.

    Frames are grouped into bounded parts first. The frame total is then joined
    on (document, part) after being repeated once per part, so even a document
    with a third of all frames joins part by part.
    """
    part = _block(frame_no, frames_per_part, 1)
    body = T.strip(F.col(text))
    present = F.when(body != "", F.struct(F.col(frame_no).alias("no"), body.alias("body")))
    parts = frames.groupBy(doc_id, part.alias("part_no")).agg(
        F.sort_array(F.collect_list(present)).alias("frames"),
        F.count(F.lit(1)).alias("frames_here"),
    )
    totals = (
        frames.groupBy(doc_id, part.alias("part_no"))
        .agg(F.count(F.lit(1)).alias("frames_here"))
        .groupBy(doc_id)
        .agg(F.sum("frames_here").alias("n_frames"), F.collect_list("part_no").alias("part_nos"))
        .select(doc_id, "n_frames", F.explode("part_nos").alias("part_no"))
    )
    n = F.col("n_frames").cast("string")
    pieces = F.transform(
        F.col("frames"),
        lambda f: F.concat(
            F.when(
                F.col("n_frames") > 1,
                F.concat(F.lit("--- Frame "), f["no"].cast("string"), F.lit("/"), n, F.lit(" ---\n")),
            ).otherwise(""),
            f["body"],
            F.lit("\n"),
        ),
    )
    return parts.join(totals, [doc_id, "part_no"]).select(
        doc_id,
        "part_no",
        F.array_join(pieces, "").alias("text"),
        F.size("frames").cast("long").alias("pages_processed"),
        F.col("n_frames"),
    )
