"""Where job messages, listings and documents come from."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwork import constants as C
from leafwork.functions.paths import document_type_of, extension
from leafwork.sources.listing import list_tree, scan_changes
from leafwork.sources.uris import qualified, store_uri

#: Bytes that one cell holds.
LARGEST_CELL = 2**31 - 16
#: Rows with fetched bytes go on together up to so many bytes.
FETCHED_BYTES = 1 << 24
#: Files, and bytes of them, that one task reads.
FILES_PER_TASK = 2_000
#: Files of a feed to a micro-batch, which its tasks share.
FEED_FILES = 16
BYTES_PER_TASK = 1 << 27
#: Names below a folder that Spark's file readers pass over.
_HIDDEN = r"(?:\A|/)(?:\.|_(?![^/=]*=))|\._COPYING_(?:/|\z)"
BINARY_FILE_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def read_messages(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """Job messages from text files, one per line or one per file."""
    return spark.read.text(path, wholetext=whole_file)


def stream_messages(spark: SparkSession, path: str, max_files: int = 1_000) -> DataFrame:
    """Job messages from text files as they land, one per line."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)


def kafka_messages(
    spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None
) -> DataFrame:
    """Job messages from Kafka, from the earliest offset on. The connector
    comes with ``--packages org.apache.spark:spark-sql-kafka-0-10_2.13``."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    if max_offsets is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load().select(F.col("value").cast("string").alias("value"), "timestamp")


def either_case_glob(extensions: list[str]) -> str:
    """A file glob for extensions in any case: ``*.{[hH][tT][mM],...}``."""
    names = [
        "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ext.lstrip("."))
        for ext in extensions
    ]
    return "*.{" + ",".join(names) + "}"


def extensions_of(document_types: list[str]) -> list[str]:
    return [ext for ext, kind in C.EXTENSION_TYPES.items() if kind in document_types]


def _relative(spark: SparkSession, base: str) -> Column:
    """Path below ``base``, a folder: what follows its whole URI."""
    if any(c in base for c in "*?[]{}"):
        raise ValueError(f"a folder is wanted, not a pattern: {base}")
    prefix = qualified(spark, base).rstrip("/") + "/"
    return F.substr(F.col("path"), F.lit(len(prefix) + 1))


def _binary_files(
    spark: SparkSession, reader, base: str, extensions: list[str] | None
) -> DataFrame:
    reader = reader.format("binaryFile").option("recursiveFileLookup", "true")
    if extensions is not None:
        reader = reader.option("pathGlobFilter", either_case_glob(extensions))
    key = _relative(spark, base)
    return reader.load(base).select(
        "path",
        key.alias("key"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("last_modified"),
        document_type_of(F.lower(extension(key))).alias("document_type"),
        "content",
    )


def list_files(spark: SparkSession, base: str, extensions: list[str] | None = None) -> DataFrame:
    """Keys, sizes and times below a folder; file contents are not read."""
    return _binary_files(spark, spark.read, base, extensions).drop("content")


def _readable(files: DataFrame, extensions: list[str] | None) -> DataFrame:
    """Of listed files those that Spark's file readers give, too: neither hidden nor empty."""
    shown = files.where((F.col("size_bytes") > 0) & ~F.col("key").rlike(_HIDDEN))
    return shown if extensions is None else shown.where(F.col("ext").isin(extensions))


def _with_contents(spark: SparkSession, files: DataFrame, base: str, largest: int) -> DataFrame:
    """Listed files with their bytes, read by the tasks that hold their rows; those that do
    not fit a cell are not opened."""
    prefix = qualified(spark, base).rstrip("/") + "/"
    fits = F.col("size_bytes") <= largest
    too_large = F.concat(
        F.lit("File too large to read: "), F.col("size_bytes").cast("string"), F.lit(" bytes")
    )
    gone = F.concat(F.lit("Document not found: "), F.col("key"))
    asked = files.withColumn("_asked", F.when(fits, F.col("key")))
    return fetch_objects(asked, base, "_asked").select(
        F.concat(F.lit(prefix), "key").alias("path"),
        "key",
        "size_bytes",
        "last_modified",
        "document_type",
        "content",
        F.when(~fits, too_large).when(F.col("content").isNull(), gone).alias("error"),
    )


def tasks_for(rows: int, size: int, spark: SparkSession) -> int:
    """Tasks that read so many files or ranges of so many bytes in all."""
    wanted = max(-(-rows // FILES_PER_TASK), -(-size // BYTES_PER_TASK))
    return max(wanted, min(rows, spark.sparkContext.defaultParallelism), 1)


def read_documents(
    spark: SparkSession,
    base: str,
    extensions: list[str] | None = None,
    largest: int = LARGEST_CELL,
) -> DataFrame:
    """Files below a folder with their bytes. Tasks list the folder and read the files, so
    their number does not matter to the driver; files of other extensions are never opened.

    A file that does not fit a cell keeps its row, with null content and an
    ``error``; it is not opened and fails nothing else.
    """
    _relative(spark, base)  # a folder
    found = _readable(list_tree(spark, base), extensions)
    n, size = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("size_bytes"), F.lit(0))).first()
    return _with_contents(spark, found.repartition(tasks_for(n, size, spark), "key"), base, largest)


def _fitting(found: DataFrame, largest: int) -> DataFrame:
    """Files with ``error``: those that do not fit are rows without content. The size is a
    filter on the scan, so they are never opened."""
    fits = F.col("size_bytes") <= largest
    too_large = F.concat(
        F.lit("File too large to read: "), F.col("size_bytes").cast("string"), F.lit(" bytes")
    )
    read = found.where(fits).withColumn("error", F.lit(None).cast("string"))
    left = found.where(~fits).withColumn("content", F.lit(None).cast("binary"))
    return read.unionByName(left.withColumn("error", too_large))


def stream_documents(
    spark: SparkSession,
    base: str,
    extensions: list[str] | None = None,
    max_files: int = 1_000,
    largest: int = LARGEST_CELL,
) -> DataFrame:
    """Files below a folder as they appear; one that does not fit a cell is a row with an
    ``error`` and stops nothing."""
    reader = spark.readStream.schema(BINARY_FILE_SCHEMA).option("maxFilesPerTrigger", max_files)
    return _fitting(_binary_files(spark, reader, base, extensions), largest)


def stream_found(
    spark: SparkSession,
    base: str,
    manifest: str,
    feed: str,
    extensions: list[str] | None = None,
    max_files: int = 1_000,
    largest: int = LARGEST_CELL,
) -> DataFrame:
    """``stream_documents`` for folders of any number of files: one run of a watch.

    Tasks list the folder and compare it with the last run's listing (``scan_changes``); the
    files that are new are rows added to the ``feed`` table, and the stream reads that table,
    about ``max_files`` rows to a micro-batch, whose tasks fetch the bytes. The driver and the
    checkpoint know the feed's files only. A file that is gone by then is a row with an ``error``.
    """
    _relative(spark, base)
    per_file = max(max_files // FEED_FILES, 1)
    found = scan_changes(spark, base, manifest, feed=feed, rows_per_file=per_file)
    stream = (
        spark.readStream.schema(found.schema)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max(max_files // per_file, 1))
        .parquet(feed)
    )
    return _with_contents(spark, _readable(stream.where("change = 'new'"), extensions), base, largest)


def spread_small(rows: DataFrame) -> DataFrame:
    """Give a small input a task per core.

    A file of one row group is read by one task however many cores there are.
    Input that already has a partition per core, as any large one does, is
    left alone, so nothing is shuffled at scale.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def wanted_documents(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """The (key, content) rows some key asks for.

    A semi-join before anything else touches the contents: with few keys it is
    a filter on the scan, with many the contents are shuffled once, by key.
    """
    return documents.select("key", "content").join(keys.select("key"), "key", "left_semi")


def fetch_objects(rows: DataFrame, base_uri: str, key: str = "key") -> DataFrame:
    """Add ``content``: the bytes stored under each row's key below ``base_uri``,
    null where there are none.

    The form for inventories too long to list: keys come from a table, every
    task reads its own, and neither a listing nor a join touches the driver.
    Small objects go on together, up to ``FETCHED_BYTES``.
    """
    at = rows.columns.index(key)
    base_uri = store_uri(rows.sparkSession, base_uri)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(base_uri)

        def get(name: str | None) -> tuple[bytes | None]:
            if name is None:
                return (None,)
            try:
                with store.open_input_stream(f"{root}/{name}") as source:
                    return (source.read(),)
            except (FileNotFoundError, IsADirectoryError):
                return (None,)

        for batch in batches:
            names = batch.column(at).to_pylist()
            yield from fetched_batches(batch, lambda i: get(names[i]), [("content", pa.binary())])

    fields = [*rows.schema.fields, T.StructField("content", T.BinaryType())]
    return rows.mapInArrow(fetch, T.StructType(fields))


def fetched_batches(
    batch: pa.RecordBatch, fetch: Callable[[int], tuple], columns: list[tuple[str, pa.DataType]]
) -> Iterator[pa.RecordBatch]:
    """``batch`` with more columns: what ``fetch`` gives for each row, bytes first. Rows go on
    before their bytes exceed ``FETCHED_BYTES``; one with more goes alone."""

    def made(start: int, rows: list[tuple]) -> pa.RecordBatch:
        more = [pa.array(list(values), kind) for values, (_, kind) in zip(zip(*rows), columns)]
        names = [*batch.schema.names, *(name for name, _ in columns)]
        return pa.RecordBatch.from_arrays([*batch.slice(start, len(rows)).columns, *more], names=names)

    start, rows, size = 0, [], 0
    for i in range(batch.num_rows):
        row = fetch(i)
        more = len(row[0] or b"")
        if rows and size + more > FETCHED_BYTES:
            yield made(start, rows)
            start, rows, size = i, [], 0
        rows.append(row)
        size += more
    if rows:
        yield made(start, rows)


def source_key() -> Column:
    """What a job asks for: object key, URL or FTP path."""
    location = F.col("location_type")
    return (
        F.when(location == "s3", F.col("s3_key"))
        .when(location == "url", F.col("url"))
        .when(location == "ftp", F.col("ftp_path"))
    )


def fetch_documents(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """Give each job the bytes stored under its key.

    ``documents`` is (key, content): objects by key, downloads landed before by
    URL or path. A job whose key is not there gets null content and
    ``Document not found``; a job that already has an error asks for nothing.
    Many jobs may name one key: adaptive execution splits such a key on the job
    side.
    """
    prior = F.col("error") if "error" in jobs.columns else F.lit(None).cast("string")
    asking = jobs.withColumn("_key", F.when(prior.isNull(), source_key()))
    keys = asking.select(F.col("_key").alias("key"))
    stored = wanted_documents(documents, keys).withColumnRenamed("key", "_key")
    missing = F.when(
        F.col("content").isNull(),
        F.concat(F.lit("Document not found: "), F.coalesce("_key", F.lit(""))),
    )
    return (
        asking.join(stored, "_key", "left")
        .withColumn("error", F.coalesce(prior, missing))
        .drop("_key")
    )
