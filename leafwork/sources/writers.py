"""Where text, pages and metadata go."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.sources.uris import store_uri


def write_table(rows: DataFrame, path: str, partition_by: list[str] = (), mode: str = "append") -> None:
    """Texts, pages or metadata as a Parquet table: the form for large runs."""
    writer = rows.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def last_writer(rows: DataFrame, key: str, order_by: str) -> DataFrame:
    """Of rows that share an output key keep the last by ``order_by`` (unique).

    Only keys and order values are aggregated, with a map-side combine; texts
    meet the winners in a semi-join.
    """
    winners = rows.groupBy(key).agg(F.max(order_by).alias(order_by))
    return rows.join(winners, [key, order_by], "left_semi")


def write_objects(rows: DataFrame, base_uri: str, key: str = "output_key", text: str = "text") -> DataFrame:
    """One UTF-8 object per row under ``base_uri``; a receipt row per object.

    The receipts are lazy, the objects are written when they are evaluated.
    An object is written into a hidden folder of the attempt's own and moved to its name, so
    a task that runs twice leaves one whole object, and tasks that fill one folder change it
    only once for each object. Keys must be unique (``last_writer``).
    """
    base_uri = store_uri(rows.sparkSession, base_uri)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(base_uri)
        own = f"{root}/.parts-{uuid.uuid4().hex}"
        made = set()
        try:
            for batch in batches:
                sizes = []
                for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    path = f"{root}/{name}"
                    for folder in (own, path.rpartition("/")[0]):
                        if folder not in made:
                            store.create_dir(folder, recursive=True)
                            made.add(folder)
                    data = (body or "").encode()
                    part = f"{own}/{len(sizes)}.part"
                    with store.open_output_stream(part) as out:
                        out.write(data)
                    store.move(part, path)
                    sizes.append(len(data))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64())], names=["output_key", "bytes"]
                )
        finally:
            if own in made:
                store.delete_dir(own)

    return rows.select(F.col(key).alias("output_key"), text).mapInArrow(
        put, "output_key string, bytes long"
    )


def move_objects(moves: DataFrame, base_uri: str) -> DataFrame:
    """Carry out (source_key, dest_key) moves; a failed one is reported, never
    raised, and one already made (a replayed batch) counts as done. An object
    is never moved onto another: two sources named alike keep the second where
    it is, with an error."""
    base_uri = store_uri(moves.sparkSession, base_uri)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(base_uri)
        made = set()
        for batch in batches:
            errors = []
            for source, dest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                error = None
                try:
                    found = store.get_file_info([f"{root}/{source}", f"{root}/{dest}"])
                    if fs.FileType.NotFound not in (found[0].type, found[1].type):
                        error = "destination exists"
                    elif found[0].type != fs.FileType.NotFound:
                        folder = f"{root}/{dest}".rpartition("/")[0]
                        if folder not in made:
                            store.create_dir(folder, recursive=True)
                            made.add(folder)
                        store.move(f"{root}/{source}", f"{root}/{dest}")
                    elif found[1].type == fs.FileType.NotFound:
                        error = "source not found"
                except OSError as exc:
                    # Another task may have made the same move meanwhile.
                    found = store.get_file_info([f"{root}/{source}", f"{root}/{dest}"])
                    made_now = found[0].type == fs.FileType.NotFound != found[1].type
                    error = None if made_now else str(exc)
                errors.append(error)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(errors, pa.string())],
                names=["source_key", "dest_key", "error"],
            )

    return moves.select("source_key", "dest_key").mapInArrow(
        move, "source_key string, dest_key string, error string"
    )


def delete_objects(files: DataFrame, base_uri: str) -> DataFrame:
    """Delete files by ``key``; one receipt each, with the error if it failed."""
    base_uri = store_uri(files.sparkSession, base_uri)

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(base_uri)
        for batch in batches:
            errors = []
            for key in batch.column(0).to_pylist():
                try:
                    store.delete_file(f"{root}/{key}")
                    errors.append(None)
                except FileNotFoundError:
                    errors.append(None)
                except OSError as exc:
                    errors.append(f"{key}: {exc}")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(errors, pa.string())], names=["key", "error"]
            )

    return files.select("key").mapInArrow(delete, "key string, error string")
