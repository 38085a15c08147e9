"""Tables fed batch by batch whose files stay few.

A batch adds one folder; whenever ``fan`` folders of a level have come together they are
merged into one of the next, so a table of n batches has at most ``fan`` folders for each
of its log(n) levels. A folder is named by its level and the batches it holds and counts
only once its writing is complete; one that a larger one holds does not count either. So
every step can fail and be repeated: readers see each batch exactly once.

On it stand two stores that need no streaming state: the newest status per job, and the
keys ever seen, in hash buckets of which a run reads only those it touches.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from leafwork.session import stored

FAN = 8
BUCKETS = 64
_NAME = re.compile(r"L(\d+)-(\d+)-(\d+)")


class Folder(NamedTuple):
    first: int
    last: int
    level: int

    @property
    def name(self) -> str:
        return f"L{self.level:02d}-{self.first:012d}-{self.last:012d}"

    def holds(self, other: Folder) -> bool:
        return self.level > other.level and self.first <= other.first and other.last <= self.last


def _store(spark: SparkSession, table: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _complete(spark: SparkSession, table: str) -> list[Folder]:
    """Folders whose writing was finished; as few as there are levels times the fan."""
    store, path = _store(spark, table)
    if not store.exists(path):
        return []
    names = [_NAME.fullmatch(s.getPath().getName()) for s in store.listStatus(path)]
    found = [Folder(int(m[2]), int(m[3]), int(m[1])) for m in names if m]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(f for f in found if store.exists(done(f"{table}/{f.name}/_SUCCESS")))


def folders(spark: SparkSession, table: str) -> list[Folder]:
    """The folders that count, in order of their batches."""
    known = _complete(spark, table)
    return [f for f in known if not any(g.holds(f) for g in known)]


def _load(spark: SparkSession, table: str, some: list[Folder], schema: T.StructType) -> DataFrame:
    rows = spark.createDataFrame([], schema)
    for folder in some:  # each may be partitioned in itself
        rows = rows.unionByName(spark.read.schema(schema).parquet(f"{table}/{folder.name}"))
    return rows


def read(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """All rows that count, as they are now: write what is made of them before more is added."""
    return _load(spark, table, folders(spark, table), schema)


def add(
    rows: DataFrame,
    table: str,
    batch: int,
    merge: Callable[[DataFrame], DataFrame],
    partition_by: tuple[str, ...] = (),
    fan: int = FAN,
) -> None:
    """Add a batch's rows and merge what has come together. A batch that is added again takes
    the place of its first attempt; one already merged is left alone."""
    spark = rows.sparkSession
    schema = rows.schema
    if not any(f.level and f.first <= batch <= f.last for f in folders(spark, table)):
        rows.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{table}/{Folder(batch, batch, 0).name}")
    while True:
        level, run = -1, []
        for folder in reversed(folders(spark, table)):
            if run and folder.level != level:
                break
            level, run = folder.level, [folder, *run]
        if len(run) < fan:
            break
        merged = Folder(run[0].first, run[-1].last, level + 1)
        merge(_load(spark, table, run, schema)).write.mode("overwrite").partitionBy(*partition_by).parquet(f"{table}/{merged.name}")
    known, store = _complete(spark, table), _store(spark, table)[0]
    for f in known:
        if any(g.holds(f) for g in known):
            store.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/{f.name}"), True)


# --- the newest status per job ------------------------------------------------------


def _newest(log: DataFrame, job_id: str) -> DataFrame:
    newest = F.max_by(F.struct("status", "step", "ts", "event_id"), F.struct("ts", "event_id")).alias("s")
    return log.groupBy(job_id).agg(newest).select(job_id, "s.*")


def start_status_levels(
    log: DataFrame, table: str, checkpoint: str, job_id: str = "job_id", fan: int = FAN, available_now: bool = False
) -> StreamingQuery:
    """Keep the newest status per job of a log (job_id, status, step, ts, event_id), which may
    come in any order. The stream holds no state: a micro-batch stores its own newest rows,
    merging keeps one per job. ``status_now`` reads the table."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        add(_newest(batch, job_id), table, batch_id, lambda rows: _newest(rows, job_id), fan=fan)

    writer = (
        log.select(job_id, "status", "step", "ts", "event_id")
        .writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def status_now(spark: SparkSession, table: str, schema: T.StructType, job_id: str = "job_id") -> DataFrame:
    """Status and step per job, as ``latest_status`` gives them for the whole log. ``schema`` is
    the log's."""
    fields = [schema[c] for c in (job_id, "status", "step", "ts", "event_id")]
    rows = read(spark, table, T.StructType(fields))
    return _newest(rows, job_id).select(job_id, "status", "step")


# --- keys ever seen ------------------------------------------------------------------


def first_seen(
    jobs: DataFrame, table: str, run: int, order_by: list[str], key: str = "job_id", buckets: int = BUCKETS, fan: int = FAN
) -> DataFrame:
    """The earliest row of each job id that no earlier run has seen, whenever that was.

    The key table knows the run in which each key first came; a run reads the buckets that
    its own keys fall into. Runs are numbered in order; one that is repeated gives the same
    rows again. Null keys are one key.
    """
    spark = jobs.sparkSession
    named = F.coalesce(F.col(key).cast("string"), F.lit(""))
    bucket = F.pmod(F.xxhash64(F.col(key).isNull(), named), F.lit(buckets)).cast("int")
    first = F.min_by(F.struct(*jobs.columns), F.struct(*order_by)).alias("first")
    mine = jobs.groupBy(F.col(key).isNull().alias("_none"), named.alias("_key"), bucket.alias("_bucket")).agg(first)
    schema = T.StructType([
        T.StructField("_none", T.BooleanType()), T.StructField("_key", T.StringType()),
        T.StructField("_run", T.LongType()), T.StructField("_bucket", T.IntegerType()),
    ])
    touched = [r._bucket for r in mine.select("_bucket").distinct().collect()]  # at most ``buckets``
    known = read(spark, table, schema).where(F.col("_bucket").isin(touched) & (F.col("_run") < run))
    new = mine.join(known, ["_none", "_key", "_bucket"], "left_anti")

    def earliest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("_none", "_key", "_bucket").agg(F.min("_run").alias("_run")).select(*schema.names)

    keys = new.select("_none", "_key", F.lit(run).cast("long").alias("_run"), "_bucket")
    add(keys, table, run, earliest, ("_bucket",), fan)
    known = read(spark, table, schema).where(F.col("_bucket").isin(touched) & (F.col("_run") == run))
    # Written now: a later run may merge the folders it comes from.
    return stored(mine.join(known, ["_none", "_key", "_bucket"], "left_semi").select("first.*"), "first-seen")
