"""Folders of many small files: listed and read by tasks, sent on together."""

import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafwork.operators import office, parts
from leafwork.sources import readers
from leafwork.streaming import streams
from leafwork.workload import archives


def _plan(df):
    return df._jdf.queryExecution().toString()


def _store(folder, names):
    for name in names:
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text("" if "empty" in name else name)


def test_joins_of_many_part_facts_are_not_broadcast(spark, rows, monkeypatch):
    monkeypatch.setattr(parts, "BROADCAST_PARTS", 10)
    made = rows("doc_id int, part_no long, text string", *((d, n, "ab,\n") for d in range(3) for n in range(4)))
    whole = parts.aligned(made, "N", F.lit("N"), [F.lit(1)])
    assert "BroadcastHashJoin" not in _plan(whole) and "SortMergeJoin" in _plan(whole)
    texts = {}
    for r in whole.orderBy("doc_id", "part_no").collect():
        texts[r.doc_id] = texts.get(r.doc_id, "") + r.text
    assert texts == {d: "ab,\n" * 4 for d in range(3)}


def test_documents_are_listed_and_read_by_tasks(spark, tmp_path):
    _store(tmp_path, ["a.txt", "b/c.TXT", "b/d.html", "_x.txt", ".y.txt", "b/_k=1/e.txt", "empty.txt", "_z/f.txt", "g.txt._COPYING_"])
    found = readers.read_documents(spark, str(tmp_path), [".txt"])
    assert "binaryFile" not in _plan(found)
    assert sorted((r.key, bytes(r.content).decode(), r.error) for r in found.collect()) == [
        ("a.txt", "a.txt", None), ("b/_k=1/e.txt", "b/_k=1/e.txt", None), ("b/c.TXT", "b/c.TXT", None),
    ]
    by_spark = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[tT][xX][tT]").format("binaryFile").load(str(tmp_path))
    columns = ["path", F.unix_millis("modificationTime"), F.col("length"), "content"]
    mine = found.select("path", F.unix_millis("last_modified"), "size_bytes", "content")
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, by_spark.select(*columns).collect()))


@pytest.mark.parametrize("limit, sizes", [(100, [4]), (6, [2, 1, 1]), (0, [1, 1, 1, 1])])
def test_small_objects_go_on_together(monkeypatch, limit, sizes):
    monkeypatch.setattr(readers, "FETCHED_BYTES", limit)
    batch = pa.RecordBatch.from_pydict({"key": ["a", "b", "c", "d"]})
    data = [b"abc", b"xyz", b"0123456789", None]
    made = list(readers.fetched_batches(batch, lambda i: (data[i], str(i)), [("content", pa.binary()), ("error", pa.string())]))
    assert [b.num_rows for b in made] == sizes
    assert [row for b in made for row in b.to_pylist()] == [
        {"key": k, "content": d, "error": str(i)} for i, (k, d) in enumerate(zip("abcd", data))
    ]


def test_a_watch_fed_by_listings_sees_each_file_once(spark, tmp_path):
    base, out = tmp_path / "in", str(tmp_path / "out")
    _store(base, [f"t/{n}.txt" for n in range(30)] + ["long-name-of-a-file.txt", "x.zip", "empty.txt"])

    def drain():
        stream = readers.stream_found(
            spark, str(base), str(tmp_path / "manifest"), str(tmp_path / "feed"), [".txt"], max_files=8, largest=10
        )
        streams.start_folder_watch(stream, out, str(tmp_path / "log"), types=["txt"], available_now=True).awaitTermination()
        return sorted((r.key, r.success, r.text, r.error) for r in spark.read.parquet(out).collect())

    first = sorted(
        [(f"t/{n}.txt", True, f"t/{n}.txt", None) for n in range(30)]
        + [("long-name-of-a-file.txt", False, None, "File too large to read: 23 bytes")]
    )
    assert drain() == first
    assert len(list((tmp_path / "out").glob("batch_id=*"))) > 1
    assert drain() == first
    _store(base, ["u.txt"])
    assert drain() == sorted([*first, ("u.txt", True, "u.txt", None)])


def _office_rows(kind, content):
    return list(office._elements(kind, content))


@pytest.mark.parametrize("kind", ["docx", "xlsx", "pptx", "odt"])
def test_small_members_are_read_once_and_as_streamed(monkeypatch, kind):
    content = archives._build(kind, 7, "one & two\n\n\tthree\nfour\nfive", "en", "web")
    opened, plain = [], zipfile.ZipFile.open
    monkeypatch.setattr(zipfile.ZipFile, "open", lambda self, name, *a, **k: (opened.append(str(name)), plain(self, name, *a, **k))[1])
    kept = _office_rows(kind, content)
    assert len(opened) == len(set(opened)) and opened
    monkeypatch.setattr(office, "SMALL_MEMBERS", 0)
    assert _office_rows(kind, content) == kept
    for cut in range(0, len(content), 97):  # damaged anywhere, told alike
        bad = content[:cut] + b"\xff\x00" + content[cut + 2 :]
        streamed = _office_rows(kind, bad)
        monkeypatch.setattr(office, "SMALL_MEMBERS", 1 << 20)
        assert _office_rows(kind, bad) == streamed
        monkeypatch.setattr(office, "SMALL_MEMBERS", 0)
