"""Vector bin packing of token sequences.

An example has a demand in three dimensions: tokens, segments (one) and loss-bearing
tokens. Bins are filled by the dot-product heuristic: of the examples that fit, the one
whose demand, weighted by how scarce each dimension is, points most along what the bin
has left. What does not fit may be cut, so bins fill up to the last token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm.tokens import encoder

SEQUENCE = 2048
#: Examples and tokens that a task packs together: what it holds in memory.
POOL_ITEMS = 4096
POOL_TOKENS = 1 << 20


class Packer:
    """Packs pieces (key, start, ids, loss-bearing?) into sequences; ``take`` gets what is full."""

    def __init__(self, tokens: int, segments: int, loss: int, first_id: int = 0):
        self.limits = np.array([tokens, segments, loss], float)
        self.tokens, self.segments, self.loss = tokens, segments, loss
        self.next_id, self.pool, self.held, self.done = first_id, [], 0, []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, start, ids, _ in pieces:
            self.done.append((key, start, ids, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def add(self, key, ids: np.ndarray, bears_loss: bool = True) -> None:
        """Whole sequences of a long example at once; its rest goes to the pool."""
        most = min(self.tokens, self.loss) if bears_loss else self.tokens
        at = 0
        while most == self.tokens and len(ids) - at >= most:
            self.emit([(key, at, ids[at : at + most], bears_loss)])
            at += most
        while at < len(ids):
            part = ids[at : at + most]
            self.pool.append((key, at, part, bears_loss))
            self.held += len(part)
            at += len(part)
        if len(self.pool) >= POOL_ITEMS or self.held >= POOL_TOKENS:
            self.pack(last=False)

    def pack(self, last: bool) -> None:
        pool = self.pool
        size = np.array([len(p[2]) for p in pool], np.int64)
        bears = np.array([p[3] for p in pool], bool)
        demand = np.stack([size, np.ones(len(pool)), size * bears], 1) / self.limits
        alive = size > 0
        scarce = demand.sum(0) / max(demand.sum(), 1e-9)
        cut: dict[int, int] = {}  # tokens of an example already placed
        left = int(size.sum())
        self.pool, self.held = [], 0
        while left:
            room, bin_ = np.array([self.tokens, self.segments, self.loss], np.int64), []
            while room[0] and room[1]:
                score = (demand * (scarce * (room / self.limits))).sum(1)
                fits = alive & (size <= room[0]) & (~bears | (size <= room[2]))
                could = alive if room[2] else alive & ~bears
                if room[1] == 1 and could.any():  # the last segment takes all the room
                    k = int(np.argmax(np.where(could, size, -1)))
                elif fits.any():
                    k = int(np.argmax(np.where(fits, score, -1.0)))
                elif could.any():
                    k = int(np.argmax(np.where(could, size, -1)))
                else:
                    break
                n = int(min(size[k], room[0], room[2] if bears[k] else room[0]))
                key, start, ids, loss = pool[k]
                at = cut.get(k, 0)
                bin_.append((key, start + at, ids[at : at + n], loss))
                cut[k] = at + n
                size[k] -= n
                alive[k] = size[k] > 0
                demand[k] = np.array([size[k], 1, size[k] * bears[k]]) / self.limits
                room -= np.array([n, 1, n * bears[k]])
                left -= n
            if room[0] and not left:  # not full, nothing left: wait for more, or end
                if last:
                    self.tail(bin_)
                else:
                    self.pool, self.held = bin_, sum(len(p[2]) for p in bin_)
            else:
                self.emit(bin_)

    def tail(self, pieces: list[tuple]) -> None:
        """The last tokens in sequences whose lengths are powers of two: no padding."""
        while pieces:
            total = sum(len(p[2]) for p in pieces)
            n, out, rest = 1 << (total.bit_length() - 1), [], []
            for key, start, ids, loss in pieces:
                if n:
                    out.append((key, start, ids[:n], loss))
                if len(ids) > n:
                    rest.append((key, start + n, ids[n:], loss))
                n = max(0, n - len(ids))
            self.emit(out)
            pieces = rest

    def take(self) -> list[tuple]:
        done, self.done = self.done, []
        return done


def pack_examples(
    rows: DataFrame,
    path: str,
    end_id: int = 1,
    tokens: int = SEQUENCE,
    segments: int = 512,
    loss: int = SEQUENCE,
    key: str = "doc_id",
    text: str = "text",
    bears_loss: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``path`` is the tokenizer's file. ``bears_loss`` names a boolean column (null: false);
    without it every token bears loss. Each task packs the rows it reads, with no shuffle;
    only a task's last sequences may be short, and their lengths are powers of two. A null
    text counts as empty, an empty one is its end id, a null key is kept, repeated rows are
    packed each, an empty table gives no rows, other columns are not read.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        from pyspark import TaskContext

        enc = encoder(path)
        end = np.array([end_id], enc.type)
        packer = Packer(tokens, segments, loss, TaskContext.get().partitionId() << 33)

        def out(force: bool):
            if packer.done and (force or len(packer.done) >= 10_000):
                done = [
                    ((k[0], s, len(i), crc32(i.astype("<u4").tobytes()), k[1], q, o)) for k, s, i, q, o in packer.take()
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done)], names=names)

        for batch in batches:
            for doc, body, bears in zip(*(batch.column(k).to_pylist() for k in range(3))):
                ids = np.concatenate([enc.ids(body), end])
                packer.add((doc, len(ids)), ids, bears)
                yield from out(False)
        packer.pack(last=True)
        yield from out(True)

    bears = F.coalesce(F.col(bears_loss), F.lit(False)) if bears_loss else F.lit(True)
    read = rows.select(F.col(key).cast("long").alias("k"), F.coalesce(text, F.lit("")).alias("t"), bears.alias("b"))
    return read.mapInArrow(run, schema)
