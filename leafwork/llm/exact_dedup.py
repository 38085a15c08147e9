"""Exact dedup by an extendible-hash index on shared files.

Each task first folds the copies it reads. What is left is keyed by leading bits of a
hash; a directory of buckets doubles as long as a bucket is overfull; owner tasks each
take a range of keys, walk it in order, chain texts whose keys collide and compare bytes.
The index - bucket, key, chain, document that stays - is a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from leafwork.llm.common import partitions, saved

KEY_BITS = 60
BUCKET_ENTRIES = 1024
#: The directory stays this small (it is broadcast): buckets hold more where it would not.
MOST_BUCKETS = 1 << 17
#: Text that a task folds at a time: what it holds in memory.
FOLD_BYTES = 24 << 20


def normalised(text: Column) -> Column:
    """White space runs as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def fold(rows: DataFrame, carried: list[str]) -> DataFrame:
    """Rows with their task's copies folded: of copies read together the one with the
    smallest id carries the text and ``n`` rows, the others point to it (``carrier``)."""
    out = StructType(
        [StructField("rid", LongType()), StructField("carrier", LongType()), StructField("n", LongType())]
        + [f for f in rows.schema if f.name != "_norm"]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rid = TaskContext.get().partitionId() << 33

        def folded(window: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal rid
            if not sum(b.num_rows for b in window):
                return
            # A number for each different text; texts stay in the batches.
            codes = pa.chunked_array([b.column("_norm") for b in window]).dictionary_encode()
            text = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in codes.chunks])
            ids = pa.chunked_array([b.column("_id") for b in window])
            none = ids.is_null().to_numpy()
            order = np.lexsort((ids.fill_null(0).to_numpy(), none, text))  # stable: then by place
            first = np.flatnonzero(np.concatenate([[True], np.diff(text[order]) != 0]))
            best = order[first]  # by text, whose numbers have no gaps
            count = np.bincount(text)
            at = 0
            for batch in window:
                mine = text[at : at + batch.num_rows]
                rows = np.arange(at, at + batch.num_rows)
                at += batch.num_rows
                keeps = best[mine] == rows
                cols = (rid + rows, rid + best[mine], np.where(keeps, count[mine], 0))
                arrays, names = [pa.array(x, pa.int64()) for x in cols], ["rid", "carrier", "n"]
                keeps = pa.array(keeps)
                for name in batch.schema.names:
                    if name != "_norm":
                        col = batch.column(name)
                        arrays.append(pc.if_else(keeps, col, pa.scalar(None, col.type)) if name in carried else col)
                        names.append(name)
                yield pa.RecordBatch.from_arrays(arrays, names=names)
            rid += at

        window, size = [], 0
        for batch in batches:
            window.append(batch)
            size += batch.nbytes
            if size >= FOLD_BYTES:
                yield from folded(window)
                window, size = [], 0
        if window:
            yield from folded(window)

    return rows.mapInArrow(run, out)


def directory(keys: DataFrame, entries: int = BUCKET_ENTRIES, key_bits: int = KEY_BITS) -> tuple[DataFrame, int]:
    """The directory over ``key``: (pointer, bucket) rows, one per value of the leading
    bits, and how many bits lead. Doubles while a bucket is overfull and can be split."""
    n = keys.count()
    capacity = max(entries, n // MOST_BUCKETS)
    depth = min(key_bits, max(0, (max(n, 1) // capacity).bit_length() - 1))
    finest = min(key_bits, depth + 6)
    cell = F.shiftright("key", key_bits - finest).alias("cell")
    cells = saved(keys.groupBy(cell).agg(F.count("*").alias("n")), "dedup-cells", n)
    open_cells, settled = cells, []
    while True:
        bucket = F.shiftright("cell", finest - depth)
        load = open_cells.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"))
        full = load.where(F.col("n") > capacity)
        done = depth >= finest or not full.limit(1).count()
        settled.append((depth, load if done else load.where(F.col("n") <= capacity)))
        if done:
            break
        split = saved(full.select("bucket"), "dedup-overfull", n)
        open_cells = open_cells.withColumn("bucket", bucket).join(split, "bucket", "left_semi").drop("bucket")
        depth += 1  # the directory doubles
    buckets = None
    for d, load in settled:
        first = F.shiftleft("bucket", depth - d)
        part = load.select(first.alias("first"), F.lit(d).alias("depth"), "n")
        buckets = part if buckets is None else buckets.union(part)
    table = saved(buckets, "dedup-directory", n)
    pointers = table.selectExpr(
        f"explode(sequence(first, first + shiftleft(1L, {depth} - depth) - 1)) AS pointer", "first AS bucket"
    )
    return pointers, depth


def walk(entries: DataFrame, carried: list[str]) -> DataFrame:
    """Owner tasks: entries in order of key and id -> each one's chain and the first of
    its text. A key's different texts, of which there is hardly ever more than one, are
    all that is held. ``carried`` columns stay on the first of a text only."""
    out = StructType(
        [StructField(n, LongType()) for n in ("rid", "bucket", "key", "chain", "keep_rid", "keep_id", "n")]
        + [f for f in entries.schema if f.name in carried]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chain = None, []
        for batch in batches:
            cols = [batch.column(n).to_pylist() for n in ("rid", "_id", "key")]
            places, rids, ids = [], [], []
            for rid, doc, k, text in zip(*cols, batch.column("_norm")):
                text = text.as_py()  # one at a time
                if k != key:
                    key, chain = k, []
                for place, (known, _, _) in enumerate(chain):
                    if known == text:
                        break
                else:
                    place = len(chain)
                    chain.append((text, rid, doc))
                places.append(place)
                rids.append(chain[place][1])
                ids.append(chain[place][2])
            first = pa.array([a == b for a, b in zip(cols[0], rids)], pa.bool_())
            arrays = [batch.column("rid"), batch.column("bucket"), batch.column("key")]
            arrays += [pa.array(x, pa.int64()) for x in (places, rids, ids)] + [batch.column("n")]
            names = ["rid", "bucket", "key", "chain", "keep_rid", "keep_id", "n"]
            for c in carried:
                col = batch.column(c)
                arrays.append(pc.if_else(first, col, pa.scalar(None, col.type)))
                names.append(c)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return entries.mapInArrow(run, out)


def build_index(
    docs: DataFrame, id_col: str, text_col: str, carry: list[str], key_bits: int = KEY_BITS, entries: int = BUCKET_ENTRIES
) -> tuple[DataFrame, DataFrame]:
    """(members, index): rid, carrier, doc id and digest of every row; the index table."""
    spark = docs.sparkSession
    norm = normalised(F.col(text_col))
    given = docs.select(
        F.col(id_col).cast("long").alias("_id"), norm.alias("_norm"), F.col(text_col).alias("_text"),
        *[F.col(c).alias(f"_c_{c}") for c in carry if c != text_col],
    ).withColumn("_sha", F.sha2("_norm", 256))
    key = F.conv(F.substring("_sha", 1, 15), 16, 10).cast("long")
    given = given.withColumn("key", F.shiftright(key, 60 - key_bits))
    carried = ["_text", *[f"_c_{c}" for c in carry if c != text_col]]
    folded = saved(fold(given, carried), "dedup-folded")
    carriers = folded.where("rid = carrier")
    pointers, depth = directory(carriers.select("key"), entries, key_bits)
    owners = partitions(spark)
    routed = (
        carriers.withColumn("pointer", F.shiftright("key", key_bits - depth))
        .join(F.broadcast(pointers) if depth <= 20 else pointers, "pointer")
        # Owners take ranges of buckets, and so of keys.
        .withColumn("_owner", F.expr(f"CAST(bucket * {owners}L DIV {1 << depth}L AS INT)"))
        .repartitionById(owners, F.col("_owner"))
        .sortWithinPartitions("key", F.col("_id").asc_nulls_last(), "rid")
        .withColumn("_norm", normalised(F.col("_text")))
    )
    keep = carried if carry else []
    index = saved(walk(routed.select("rid", "bucket", "key", "n", "_id", "_norm", *keep), keep), "dedup-index")
    return folded.select("rid", "carrier", "_id", "_sha"), index


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain.

    Null texts equal empty ones. The smallest id of a group stays; null ids come after all
    others, and of repeated rows one stays. An empty table gives no rows; other columns
    are not read.
    """
    members, index = build_index(docs, id_col, text_col, [], **limits)
    sizes = index.groupBy("keep_rid").agg(F.sum("n").alias("group_size"))
    found = index.select(F.col("rid").alias("carrier"), "bucket", "chain", "keep_rid", "keep_id").join(sizes, "keep_rid")
    return members.join(found, "carrier").select(
        F.col("_id").alias("doc_id"),
        "keep_id",
        "group_size",
        (F.col("rid") == F.col("keep_rid")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
        "bucket",
        "chain",
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The rows that stay, with their own columns: the owners pass them on, nothing is joined."""
    _, index = build_index(docs, id_col, text_col, docs.columns, **limits)
    names = {c: "_text" if c == text_col else f"_c_{c}" for c in docs.columns}
    return index.where("rid = keep_rid").select(*[F.col(names[c]).alias(c) for c in docs.columns])
