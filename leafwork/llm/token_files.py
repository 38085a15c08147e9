"""Token ids in binary files: fixed-width bit packing with random access.

File: magic, then blocks of BLOCK ids packed with ``width`` bits each (least significant
bit first), then a footer - document ids, token counts, ties, block offsets - and the
footer's length with the magic again, so a reader needs two small reads to find any id.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafwork.llm.common import partitions, saved, store_of, unique_name
from leafwork.llm.tokens import encoder
from leafwork.session import new_folder

MAGIC = b"TOKBITS1"
BLOCK = 1 << 16


def width_of(vocabulary: int) -> int:
    """Bits of the largest id."""
    return max(1, (max(vocabulary, 1) - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids below ``2 ** width`` in that many bits each, lowest bits first; no ids, no bytes."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    """The first ``n`` ids that ``pack`` has put into ``data``."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype("<u4")
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


class Writer:
    """Appends documents to one file; holds a block of ids and two numbers per document."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.out.write(MAGIC)
        self.at, self.offsets, self.docs, self.counts = len(MAGIC), [len(MAGIC)], [], []
        self.held: list[np.ndarray] = []
        self.n_held = self.total = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        self.total += len(ids)
        if self.n_held >= BLOCK:
            self.flush(self.n_held // BLOCK * BLOCK)

    def flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, "<u4")
        for k in range(0, n, BLOCK):
            data = pack(ids[k : min(k + BLOCK, n)], self.width)
            self.out.write(data)
            self.at += len(data)
            self.offsets.append(self.at)
        self.held = [ids[n:]] if n < len(ids) else []
        self.n_held = len(ids) - n

    def close(self) -> None:
        self.flush(self.n_held)
        null = np.array([d is None for d in self.docs], np.uint8)
        docs = np.array([d or 0 for d in self.docs], "<i8")
        parts = [docs.tobytes(), null.tobytes(), np.array(self.counts, "<i8").tobytes(), np.array(self.offsets, "<i8").tobytes()]
        head = {"width": self.width, "docs": len(self.docs), "ids": self.total, "block": BLOCK, "blocks": len(self.offsets)}
        footer = json.dumps(head).encode() + b"\n" + b"".join(parts)
        self.out.write(footer)
        self.out.write(len(footer).to_bytes(8, "little") + MAGIC)


class Reader:
    """Documents and ids of one file; any range of ids without reading the rest."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - 16)
        tail = file.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token file, or cut short")
        length = int.from_bytes(tail[:8], "little")
        file.seek(size - 16 - length)
        head, _, data = file.read(length).partition(b"\n")
        self.head = json.loads(head)
        n, blocks = self.head["docs"], self.head["blocks"]
        if len(data) != 17 * n + 8 * blocks:
            raise ValueError("the footer's length is wrong")
        self.docs = np.frombuffer(data, "<i8", n)
        self.null = np.frombuffer(data, np.uint8, n, 8 * n).astype(bool)
        self.counts = np.frombuffer(data, "<i8", n, 9 * n)
        self.offsets = np.frombuffer(data, "<i8", blocks, 17 * n)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)
        if self.starts[-1] != self.head["ids"]:
            raise ValueError("token counts do not add up")

    def block(self, k: int) -> np.ndarray:
        size = self.head["block"]
        n = min(size, self.head["ids"] - k * size)
        self.file.seek(int(self.offsets[k]))
        return unpack(self.file.read(int(self.offsets[k + 1] - self.offsets[k])), n, self.head["width"])

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end of the file, from the blocks that hold them."""
        if end <= start:
            return np.empty(0, "<u4")
        size = self.head["block"]
        first, last = start // size, (end - 1) // size
        found = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return found[start - first * size : end - first * size]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids of the file before it, its ids), a block in memory at a time."""
        size, held, first = self.head["block"], {}, 0
        for k, (doc, null) in enumerate(zip(self.docs.tolist(), self.null.tolist())):
            start, end = int(self.starts[k]), int(self.starts[k + 1])
            parts = []
            for b in range(start // size, (max(end, start + 1) - 1) // size + 1):
                if end == start:
                    break
                if b not in held:
                    held = {b: self.block(b)}
                parts.append(held[b][max(start - b * size, 0) : end - b * size])
            yield (None if null else doc), start, np.concatenate(parts) if parts else np.empty(0, "<u4")


def write_tokens(docs: DataFrame, path: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Files of the documents' ids in ascending order of doc_id; returns the manifest:
    shard, file, n_docs, n_ids, first_id (ids of all shards before).

    ``path`` is the tokenizer's file. Documents are dealt by ranges of doc_id, so the shards
    in order are the whole; null ids come first, equal ones lie by text. Null and empty
    texts hold the end id alone; an empty table gives an empty manifest; other columns
    are not read. A file belongs to one attempt of a task and counts once the manifest
    names it, so lost tasks leave no halves.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-files")
    shards = partitions(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, writer, out = TaskContext.get().partitionId(), None, None
        enc = encoder(path)
        end = np.array([end_id], enc.type)
        store, root = store_of(folder)
        name = f"{root}/{unique_name(f'shard-{shard:06d}', '.tok')}"
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if writer is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(name)
                    writer = Writer(out, width_of(max(enc.size, end_id + 1)))
                writer.add(doc_id, np.concatenate([enc.ids(text), end]))
        if writer:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"shard": [shard], "file": [name], "n_docs": [len(writer.docs)], "n_ids": [writer.total]},
                pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
            )

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = texts.repartitionByRange(shards, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    manifest = saved(dealt.mapInArrow(write, "shard int, file string, n_docs long, n_ids long"), "token-manifest")
    # One row per file: a window over them is small whatever the documents are.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    manifest = manifest.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))
    return saved(manifest.withColumn("uri", F.lit(folder)), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of the manifest."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    fields = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        for batch in batches:
            for row in batch.to_pylist():
                store, _ = store_of(row["uri"])
                with store.open_input_file(row["file"]) as file:
                    reader, out = Reader(file), []
                    if (reader.head["docs"], reader.head["ids"]) != (row["n_docs"], row["n_ids"]):
                        raise ValueError(f"{row['file']} is not what the manifest says")
                    for doc_id, start, ids in reader.documents():
                        out.append((doc_id, row["first_id"] + start, len(ids), crc32(ids.tobytes())))
                        if len(out) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=fields)
                            out = []
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=fields)

    files = manifest.repartitionById(partitions(manifest.sparkSession), F.col("shard"))
    return files.mapInArrow(read, schema)
