"""Folders listed by tasks, and what changed since the last listing.

A tree is listed breadth-first: the folders of a level are rows, each listed by the task
that holds it, and what they hold is written before the next level. Listings are kept as
versions of a manifest; a run joins the listing with the last version, so that only files
that are new or changed go on, and files that are gone are told.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.functions.paths import document_type_of, extension
from leafwork.session import stored
from leafwork.sources.uris import store_uri

ENTRIES = "key string, is_folder boolean, size_bytes long, last_modified timestamp"


def _listed(folders: DataFrame, base_uri: str) -> DataFrame:
    """Entries of each folder (``key`` below the base, "" for the base itself). A folder that
    went meanwhile has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(base_uri)
        root = root.rstrip("/")
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                path = f"{root}/{folder}" if folder else root
                found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
                for k in range(0, len(found), 10_000):
                    some = found[k : k + 10_000]
                    # Relative to the folder: stores differ in how they spell the root.
                    names = [f"{folder}/{x.base_name}" if folder else x.base_name for x in some]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(names, pa.string()), pa.array([x.type == fs.FileType.Directory for x in some], pa.bool_()),
                            pa.array([x.size if x.is_file else None for x in some], pa.int64()),
                            pa.array([x.mtime_ns // 1000 if x.mtime_ns else None for x in some], pa.timestamp("us", "UTC")),
                        ],
                        names=["key", "is_folder", "size_bytes", "last_modified"],
                    )

    return folders.select("key").mapInArrow(run, ENTRIES)


def list_tree(spark: SparkSession, base: str) -> DataFrame:
    """Files below a folder: key, size_bytes, last_modified, ext, document_type.

    As many steps as the tree is deep; the driver sees the number of folders of a level,
    never their names.
    """
    base_uri = store_uri(spark, base)
    level, files = spark.range(1).select(F.lit("").alias("key")), None
    while True:
        entries = stored(_listed(level, base_uri), "listing")
        mine = entries.where(~F.col("is_folder"))
        files = mine if files is None else files.unionByName(mine)
        level = entries.where("is_folder").select("key")
        if level.isEmpty():
            break
        level = level.repartition("key")
    ext = F.lower(extension(F.col("key")))
    return files.select("key", "size_bytes", "last_modified", ext.alias("ext"), document_type_of(ext).alias("document_type"))


def versions(spark: SparkSession, manifest: str) -> list[int]:
    """Complete versions of a manifest, in order: those whose writing was finished."""
    jvm, path = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(manifest)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return []
    names = [s.getPath().getName() for s in store.listStatus(path)]
    found = [int(n.removeprefix("version=")) for n in names if n.startswith("version=")]
    return sorted(
        v for v in found if store.exists(jvm.org.apache.hadoop.fs.Path(f"{manifest}/version={v:08d}/_SUCCESS"))
    )


def compare(listing: DataFrame, last: DataFrame) -> DataFrame:
    """``listing`` against the last one: a row per key with ``change``: new, changed (another
    size or time), gone (with what was known of it) or same."""
    before = last.select(
        "key", F.col("size_bytes").alias("_size"), F.col("last_modified").alias("_time"), F.lit(True).alias("_known")
    )
    now = listing.select("key", "size_bytes", "last_modified", F.lit(True).alias("_here"))
    same = F.col("size_bytes").eqNullSafe(F.col("_size")) & F.col("last_modified").eqNullSafe(F.col("_time"))
    change = (
        F.when(F.col("_known").isNull(), "new").when(F.col("_here").isNull(), "gone").when(same, "same").otherwise("changed")
    )
    ext = F.lower(extension(F.col("key")))
    return now.join(before, "key", "full").select(
        "key", F.coalesce("size_bytes", "_size").alias("size_bytes"), F.coalesce("last_modified", "_time").alias("last_modified"),
        ext.alias("ext"), document_type_of(ext).alias("document_type"), change.alias("change"),
    )


def scan_changes(
    spark: SparkSession, base: str, manifest: str, keep: int = 2, feed: str | None = None, rows_per_file: int = 0
) -> DataFrame:
    """One run: lists ``base``, writes the listing as the manifest's next version and returns
    the files that are new, changed or gone since the last complete version.

    A run that fails before its version is complete changes nothing: the next one compares
    with the same version again. The last ``keep`` versions stay, older ones are deleted.

    ``feed`` names a table, a folder per version, that the changes are added to before the
    version is complete, ``rows_per_file`` at most to a file; a repeated run writes its own again.
    """
    known = versions(spark, manifest)
    listing = stored(list_tree(spark, base), "scan")
    last = spark.read.schema(listing.schema).parquet(f"{manifest}/version={known[-1]:08d}") if known else listing.limit(0)
    changes = stored(compare(listing, last).where("change <> 'same'"), "scan-changes")
    following = known[-1] + 1 if known else 1
    if feed is not None:
        # In order of the keys' hashes, so that files are full and hold files of all folders.
        dealt = changes.repartitionByRange(F.xxhash64("key"))
        dealt.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(f"{feed}/{following:08d}")
    listing.write.mode("overwrite").parquet(f"{manifest}/version={following:08d}")
    for old in known[: max(len(known) + 1 - keep, 0)]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{manifest}/version={old:08d}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return changes
