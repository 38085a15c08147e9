"""Files of any size, read in ranges.

A file is planned as rows (key, part_no, offset, length); every range is read by the task
that holds its row, so one file spreads over as many tasks as it has parts and no cell
holds more than a part. ``operators.parts`` goes on from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwork.sources.listing import list_tree
from leafwork.sources.readers import fetched_batches, tasks_for
from leafwork.sources.uris import store_uri

#: Bytes of a part; even, as characters of UTF-16 are not to be cut.
PART_BYTES = 64 << 20


def byte_ranges(files: DataFrame, part_bytes: int = PART_BYTES, size: str = "size_bytes") -> DataFrame:
    """``files`` with a row per part: part_no from 0, offset and length. An empty file has
    one empty part, so that it is not lost."""
    if part_bytes < 2 or part_bytes % 2:
        raise ValueError("a part has an even number of bytes")
    parts = F.greatest(F.ceil(F.col(size) / part_bytes), F.lit(1)).cast("long")
    numbered = files.withColumn("part_no", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    offset = F.col("part_no") * part_bytes
    return numbered.withColumn("offset", offset).withColumn(
        "length", F.greatest(F.least(F.lit(part_bytes), F.col(size) - F.col("offset")), F.lit(0)).cast("long")
    )


def read_ranges(ranges: DataFrame, base_uri: str, key: str = "key", tasks: int | None = None) -> DataFrame:
    """Add ``content``, the bytes of each (key, offset, length) below ``base_uri``, and ``error``:
    a file that is gone or shorter than its plan is told, and fails nothing else.

    Ranges are dealt out by (key, part), to so many ``tasks`` if that is given; small ones go
    on together.
    """
    base_uri = store_uri(ranges.sparkSession, base_uri)
    at = {name: ranges.columns.index(name) for name in (key, "offset", "length")}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(base_uri)

        def get(name: str, offset: int, length: int) -> tuple[bytes | None, str | None]:
            try:
                with store.open_input_file(f"{root}/{name}") as source:
                    data = source.read_at(length, offset)
                return (None, f"File is shorter than listed: {name}") if len(data) < length else (data, None)
            except (FileNotFoundError, IsADirectoryError):
                return None, f"Document not found: {name}"

        for batch in batches:
            asked = list(zip(*(batch.column(at[c]).to_pylist() for c in (key, "offset", "length"))))
            yield from fetched_batches(batch, lambda i: get(*asked[i]), [("content", pa.binary()), ("error", pa.string())])

    fields = [*ranges.schema.fields, T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())]
    dealt = ranges.repartition(*([] if tasks is None else [tasks]), key, "part_no")
    return dealt.mapInArrow(read, T.StructType(fields))


def read_parts(
    spark: SparkSession, base: str, extensions: list[str] | None = None, part_bytes: int = PART_BYTES
) -> DataFrame:
    """Files below a folder in parts: key, size_bytes, document_type, part_no, offset, length,
    content, error. Tasks list the folder and read the ranges; a file may have any size."""
    files = list_tree(spark, base)
    if extensions is not None:
        files = files.where(F.col("ext").isin(extensions))
    planned = byte_ranges(files.select("key", "size_bytes", "document_type"), part_bytes)
    n, size = planned.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    return read_ranges(planned, base, tasks=tasks_for(n, size, spark))
