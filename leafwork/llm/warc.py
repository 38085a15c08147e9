"""WARC files compressed with Zstandard: one frame per record, the dictionary in front.

A file starts with a skippable frame that holds the dictionary; every record is a frame of
its own, so a reader can start at any record. Equal payloads are stored once: the record
of the smallest page id is a response, the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import HOT_KEYS, SPREAD, partitions, saved, store_of, unique_name
from leafwork.session import new_folder

#: Fixed: the skippable frame of a dictionary, and the first bytes of any Zstandard frame.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The dictionary is fitted on so many pages at most, on so many bytes of each.
DICTIONARY_PAGES, DICTIONARY_SAMPLE, DICTIONARY_BYTES = 400, 1 << 15, 1 << 15
FILE_BYTES = 1 << 30


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record(page: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A record's bytes. An empty payload is a block without a body, an empty URL an empty
    field; without an id there is no id field, and all such records share a record id."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    url = "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if page is not None:
        head.append(f"X-Page-Id: {page}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
        if refers_to is not None:
            head.append(f"X-Refers-To-Page: {refers_to}")
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's fields, after its version, header lines, lengths and digest are checked."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] != VERSION:
        raise ValueError("a record does not start with a WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or not name.strip():
            raise ValueError("a header line has no name")
        fields[name.strip().lower()] = value.strip()
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("a record's Content-Length is wrong")
    http, mark, payload = rest[:length].partition(b"\r\n\r\n")
    if not mark or not http.startswith(b"HTTP/1."):
        raise ValueError("a block holds no HTTP message")
    sizes = [x.split(b":")[1] for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    if len(sizes) != 1:
        raise ValueError("an HTTP message has no single Content-Length")
    n, kind = int(sizes[0]), fields["warc-type"]
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != n or digest_of(payload) != digest):
        raise ValueError("a payload is not what its header says")
    if kind == "revisit" and payload:
        raise ValueError("a revisit carries a payload")
    page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page")
    return {
        "page_id": None if page is None else int(page),
        "url": fields["warc-target-uri"],
        "payload": payload if kind == "response" else None,
        "payload_bytes": n,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": None if refers is None else int(refers),
    }


def dictionary_frame(dictionary: bytes) -> bytes:
    return DICTIONARY_MAGIC.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary


def frames(read, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The decoded frames of an archive. ``read(n)`` gives up to n more bytes; one chunk and
    one record are in memory."""
    import zstandard

    held = read(8)
    if not held:
        return
    dictionary = None
    if len(held) == 8 and int.from_bytes(held[:4], "little") == DICTIONARY_MAGIC:
        size, data = int.from_bytes(held[4:], "little"), b""
        while len(data) < size:
            more = read(size - len(data))
            if not more:
                raise ValueError("the dictionary frame is cut short")
            data += more
        if data[:4] == FRAME_MAGIC:  # a dictionary may itself be compressed
            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        dictionary = zstandard.ZstdCompressionDict(data) if data else None
        held = b""
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    while True:
        held = held or read(chunk)
        if not held:
            return
        frame, parts = reader.decompressobj(), []
        while True:
            parts.append(frame.decompress(held))
            if frame.eof:
                held = frame.unused_data
                break
            held = read(chunk)
            if not held:
                raise ValueError("the last frame is cut short")
        yield b"".join(parts)


def fit_dictionary(pages: DataFrame, groups: DataFrame) -> bytes:
    """A dictionary from the pages of the smallest digests; none where too few are usable.

    The digests (``groups``: sha, first_id) are chosen first, so that only the chosen pages'
    samples travel: a number of bytes that does not depend on the input.
    """
    import zstandard

    chosen = groups.where("first_id IS NOT NULL").orderBy("sha").limit(DICTIONARY_PAGES).select("sha", F.col("first_id").alias("page_id"))
    sample = F.substring("html", 1, DICTIONARY_SAMPLE).alias("h")
    found = pages.join(F.broadcast(chosen.withColumnRenamed("sha", "wanted")), "page_id").where(F.sha1("html") == F.col("wanted"))
    rows = found.select("wanted", sample).where("h <> ''").groupBy("wanted").agg(F.min("h").alias("h")).orderBy("wanted")
    samples = [r.h.encode() for r in rows.collect()]
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # samples too much alike
        return b""


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    min_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
    level: int = 3,
) -> DataFrame:
    """Archives of page_id, url, html; returns the manifest: file, records, uri.

    A null html is an empty payload, null URLs are empty, control characters in URLs are
    escaped. Payloads of at least ``min_bytes`` are stored once, smaller ones always; of
    rows with equal payload and id one is the response. Null ids count as the largest;
    a payload only they hold is one response and revisits without a reference. An empty
    table writes nothing; other columns are not read.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha1(html).alias("sha"))
    groups = saved(rows.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")), "warc-groups")
    dictionary = fit_dictionary(rows.select("page_id", "html"), groups)
    # Copies meet in one task, where the first in order is the response. Payloads that many
    # share, under a thousand by their share of the rows, are told with their first id and
    # dealt out by page id.
    total = groups.agg(F.sum("n")).first()[0] or 0
    hot = groups.where(F.col("n") > total / HOT_KEYS).select("sha", "first_id", F.lit(True).alias("hot"))
    away = F.lit(1) + F.pmod(F.xxhash64("page_id"), F.lit(SPREAD)).cast("int")
    dealt = rows.join(F.broadcast(hot), "sha", "left").withColumn("spread", F.when(F.col("hot"), away).otherwise(0))
    placed = dealt.repartition(partitions(pages.sparkSession), "sha", "spread").sortWithinPartitions(
        "sha", F.asc_nulls_last("page_id"), "url"
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        store, root = store_of(folder)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=True, write_content_size=True)
        out, name, n, size, seen, first = None, "", 0, 0, None, None
        done: list[tuple[str, int]] = []
        for batch in batches:
            for page, url, text, sha, first_id, told in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if out is None or size > FILE_BYTES:
                    if out:
                        out.close()
                        done.append((name, n))
                    store.create_dir(root, recursive=True)
                    name = f"{root}/{unique_name('pages', '.warc.zst')}"
                    out, n = store.open_output_stream(name), 0
                    size = out.write(dictionary_frame(dictionary)) or 0
                payload = text.encode()
                if seen is None or seen[0] != sha:
                    first = first_id if told else page
                revisit = len(payload) >= min_bytes and (page != first or seen == (sha, page))
                seen = (sha, page)
                frame = packer.compress(record(page, url, payload, digest_of(payload), first, revisit, date))
                out.write(frame)
                size += len(frame)
                n += 1
        if out:
            out.close()
            done.append((name, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["file", "records"])

    columns = placed.select("page_id", "url", "html", "sha", "first_id", "hot")
    return saved(columns.mapInArrow(write, "file string, records long").withColumn("uri", F.lit(folder)), "warc-manifest")


RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives a manifest names, one file per task, a record in memory."""
    schema = RECORD if payloads else RECORD.replace(" payload binary,", "")
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, _ = store_of(row["uri"])
                with store.open_input_stream(row["file"]) as file:
                    out, held, n = [], 0, 0
                    for data in frames(file.read):
                        out.append(parse(data))
                        n, held = n + 1, held + (len(data) if payloads else 100)
                        if held > 1 << 23:
                            yield pa.RecordBatch.from_pylist(out, schema=fields)
                            out, held = [], 0
                    if n != row["records"]:
                        raise ValueError(f"{row['file']} holds {n} records, not {row['records']}")
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema=fields)

    parts = partitions(manifest.sparkSession)
    files = manifest.repartition(parts, "file")
    return files.mapInArrow(read, schema)
