"""Helpers of the operators: shared tables, skew-proof lookups, word hashes, files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.session import new_folder

#: At most so many keys hold more than one part in HOT_KEYS of the rows each.
HOT_KEYS = 1000
SPREAD = 4096
#: Rows of a saved table's file, where a bound of their number is known.
FILE_ROWS = 1 << 15


def saved(rows: DataFrame, name: str, most: int | None = None, file_rows: int = FILE_ROWS) -> DataFrame:
    """Rows written to the shared folder and read back: cuts the lineage, survives lost executors.

    There are at most ``most`` of them, if it is given, and no more files than those need: each
    costs a task, and on a plain disk processes that set its rights, which count with all of
    the JVM's memory until they have started."""
    spark = rows.sparkSession
    if most is not None:
        rows = rows.coalesce(max(1, -(-most // file_rows)))
    path = new_folder(spark, name)
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lookup(rows: DataFrame, table: DataFrame, key: str, n: str, spread_by: list[str]) -> DataFrame:
    """``rows`` with the columns of ``table`` (one row per ``key``; ``n``: rows with that
    key), nulls where the key is absent.

    Keys with over a thousandth of the rows are under a thousand, so that part of the
    table is broadcast whatever the input; their rows are dealt out by ``spread_by``
    and no partition of the shuffle join holds more than one ordinary key's rows.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    values = F.struct(*[c for c in table.columns if c != key])
    hot = table.where(F.col(n) > total / HOT_KEYS).select(key, values.alias("_hot"))
    cold = table.where(F.col(n) <= total / HOT_KEYS)
    cold = cold.select(key, F.lit(0).alias("_spread"), values.alias("_cold"))
    away = F.lit(1) + F.pmod(F.xxhash64(*spread_by), F.lit(SPREAD)).cast("int")
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn(
        "_spread", F.when(F.col("_hot").isNotNull(), away).otherwise(0)
    )
    found = F.coalesce("_hot", "_cold")
    return dealt.join(cold, [key, "_spread"], "left").select(
        *rows.columns, *[found[c].alias(c) for c in table.columns if c != key]
    )


def held_out(doc_id: str | Column) -> Column:
    """Rows whose labels are never learnt from."""
    text = F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")
    return F.coalesce(F.crc32(text) % 5 == 0, F.lit(False))


def mixed(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit permutation of the values: avalanche by shifts and odd factors."""
    x = values + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A value per byte: none for white space, one for a letter in either case of A-Z.
_BYTES = mixed(np.arange(256, dtype=np.uint64), 1)
_BYTES[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES[_SPACE] = 0
_BASE = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of text hashed at once; a longer text is hashed alone.
CHUNK = 1 << 18


def word_hashes(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of texts as (64-bit hashes of their words, where each text's words start and end).

    Words are runs of anything but ASCII white space, A-Z lowered; hashes are taken over
    the bytes of many texts at a time. ``texts`` holds no nulls.
    """
    n = len(texts)
    if not n:
        return
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, wide)[texts.offset : texts.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + CHUNK, "right")) - 1)
        last = min(last, n)
        bounds = ends[first : last + 1] - ends[first]
        part = whole[ends[first] : ends[last]]
        first = last
        begins = ~_SPACE[part]
        if not begins.any():
            yield np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
            continue
        before = np.empty(len(part), bool)
        before[0], before[1:] = True, ~begins[:-1]
        before[bounds[:-1][bounds[:-1] < len(part)]] = True
        starts = np.flatnonzero(begins & before)
        lengths = np.diff(starts, append=len(part))
        place = np.arange(starts[0], len(part)) - np.repeat(starts, lengths)
        powers = np.cumprod(np.full(int(lengths.max()), _BASE))
        values = np.add.reduceat(_BYTES[part[starts[0] :]] * powers[place], starts - starts[0])
        yield mixed(values), np.searchsorted(starts, bounds)


def store_of(uri: str):
    """(file system, path) of a folder named by URI or by plain path."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri[6:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def unique_name(stem: str, ending: str) -> str:
    """No two attempts of a task write the same file."""
    return f"{stem}-{uuid.uuid4().hex[:12]}{ending}"
