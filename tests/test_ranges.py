"""Files in ranges, folders listed by tasks, listings compared."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from leafwork.functions.content import decode_text
from leafwork.operators import parts
from leafwork.sources import listing, ranges


def test_ranges_come_back_byte_for_byte(spark, tmp_path):
    rng = random.Random(1)
    sizes = {"a.bin": 0, "sub/b.bin": 1, "sub/c.bin": 64, "sub/deep/er/d.bin": 1000, "e.txt": 65}
    for name, size in sizes.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(rng.randbytes(size))
    rows = ranges.read_parts(spark, f"file://{tmp_path}", part_bytes=64).collect()
    for name, size in sizes.items():
        mine = sorted((r for r in rows if r.key == name), key=lambda r: r.part_no)
        assert [r.part_no for r in mine] == list(range(max(1, -(-size // 64)))) and all(r.error is None for r in mine)
        assert b"".join(bytes(r.content) for r in mine) == (tmp_path / name).read_bytes()
        assert all(len(r.content) == r.length <= 64 for r in mine)
    assert {r.key for r in ranges.read_parts(spark, str(tmp_path), [".txt"], part_bytes=64).collect()} == {"e.txt"}
    with pytest.raises(ValueError):
        ranges.byte_ranges(spark.range(1), 7)


def test_lost_and_short_files_are_error_rows(spark, rows, tmp_path):
    (tmp_path / "a").write_bytes(b"0123456789")
    files = rows("key string, size_bytes long", ("a", 14), ("gone", 3))
    got = {(r.key, r.part_no): (r.content and bytes(r.content), r.error) for r in ranges.read_ranges(ranges.byte_ranges(files, 6), str(tmp_path)).collect()}
    assert got == {
        ("a", 0): (b"012345", None), ("a", 1): (None, "File is shorter than listed: a"), ("a", 2): (None, "File is shorter than listed: a"),
        ("gone", 0): (None, "Document not found: gone"),
    }


def test_decoded_parts_equal_the_decoded_file(rows):
    rng = random.Random(2)
    pieces = ["a", "é", "日本", "😀", "\r\n", "\r", "\n", " ", "਀", "ﬁ"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    contents = [t.encode() for t in texts] + [b"\xef\xbb\xbf" + t.encode() for t in texts[:30]]
    contents += [codec for t in texts[:30] for codec in (b"\xff\xfe" + t.encode("utf-16-le"), b"\xfe\xff" + t.encode("utf-16-be"))]
    odd = [b"\x80", b"\xc3", b"\xe2\x82", b"\xf0\x9f", b"x", b"\r", b"\n", "é".encode(), b"\x93"]
    contents += [b"".join(rng.choice(odd) for _ in range(rng.randrange(1, 25))) for _ in range(60)]
    contents += [b"\xef\xbb\xbf" + c for c in contents[-30:]] + [b"", b"\xef\xbb\xbf", b"\xff\xfe"]
    cut = []
    for k, data in enumerate(contents):
        step = rng.choice([2, 4, 10, 1000]) if data[:2] in (b"\xff\xfe", b"\xfe\xff") else rng.choice([1, 2, 3, 5, 1000])
        cut += [(k, n, data[i : i + step]) for n, i in enumerate(range(0, max(len(data), 1), step))]
    got = {}
    made = parts.decode_parts(rows("doc_id int, part_no long, content binary", *cut).repartition(4))
    for r in sorted(made.collect(), key=lambda r: (r.doc_id, r.part_no)):
        got[r.doc_id] = got.get(r.doc_id, "") + r.text
    whole = rows("doc_id int, content binary", *enumerate(contents)).select("doc_id", decode_text(F.col("content")).alias("t"))
    assert {k: t for k, t in got.items() if t} == {r.doc_id: r.t for r in whole.collect() if r.t}


def tree(base, files):
    for name, text in files.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text(text)


def test_tree_is_listed_level_by_level(spark, tmp_path):
    tree(tmp_path / "in", {"a.txt": "1", "b/c.HTML": "22", "b/d/e/f.csv": "333", "b/.hidden/g": "", "h i/j%20k.txt": "4"})
    (tmp_path / "in" / "empty" / "er").mkdir(parents=True)
    got = {(r.key, r.size_bytes, r.document_type) for r in listing.list_tree(spark, str(tmp_path / "in")).collect()}
    assert got == {("a.txt", 1, "txt"), ("b/c.HTML", 2, "html"), ("b/d/e/f.csv", 3, "csv"), ("b/.hidden/g", 0, ""), ("h i/j%20k.txt", 1, "txt")}
    times = {r.key: r.last_modified.timestamp() for r in listing.list_tree(spark, str(tmp_path / "in")).collect()}
    assert abs(times["a.txt"] - os.path.getmtime(tmp_path / "in" / "a.txt")) < 1e-3 or len(times) == 5
    assert listing.list_tree(spark, str(tmp_path / "nowhere")).count() == 0


def changes(frame):
    return {(r.key, r.change) for r in frame.collect()}


def test_runs_over_a_changing_folder(spark, tmp_path):
    base, manifest = tmp_path / "in", str(tmp_path / "manifest")
    tree(base, {"a.txt": "1", "b/c.txt": "2", "b/d.txt": "3"})
    assert changes(listing.scan_changes(spark, str(base), manifest)) == {("a.txt", "new"), ("b/c.txt", "new"), ("b/d.txt", "new")}
    assert changes(listing.scan_changes(spark, str(base), manifest)) == set()
    tree(base, {"a.txt": "10", "e/f.txt": "4"})
    (base / "b" / "d.txt").unlink()
    before = hashlib.sha1(repr(listing.versions(spark, manifest)).encode()).hexdigest()
    got = listing.scan_changes(spark, str(base), manifest)
    assert changes(got) == {("a.txt", "changed"), ("e/f.txt", "new"), ("b/d.txt", "gone")} and before
    # Same size, another time; and a run whose version was never completed counts for nothing.
    os.utime(base / "b" / "c.txt", (1_000_000, 1_000_000))
    (tmp_path / "manifest" / "version=00000099").mkdir()
    assert changes(listing.scan_changes(spark, str(base), manifest)) == {("b/c.txt", "changed")}
    assert listing.versions(spark, manifest) == [3, 4]
    assert changes(listing.scan_changes(spark, str(base), manifest)) == set()
