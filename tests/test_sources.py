"""Readers and writers on real files."""

import pytest
from pyspark.sql import functions as F

from leafwork.operators import files
from leafwork.plans import flows
from leafwork.session import new_folder, shared_folder
from leafwork.sources import readers, writers


@pytest.fixture
def store(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("alpha")
    (tmp_path / "in" / "sub" / "b.HTM").write_text("<p>b</p>")
    (tmp_path / "in" / "c.zip").write_bytes(b"zz")
    return tmp_path


def test_list_and_read(spark, store):
    listed = readers.list_files(spark, str(store)).orderBy("key").collect()
    assert [(r["key"], r["size_bytes"], r["document_type"]) for r in listed] == [
        ("in/a.txt", 5, "txt"), ("in/c.zip", 2, ""), ("in/sub/b.HTM", 8, "html"),
    ]
    found = readers.read_documents(spark, f"file://{store}", readers.extensions_of(["html"])).collect()
    assert [(r["key"], bytes(r["content"])) for r in found] == [("in/sub/b.HTM", b"<p>b</p>")]


def test_files_beyond_a_cell_are_error_rows(spark, store):
    found = readers.read_documents(spark, str(store), largest=5).orderBy("key").collect()
    assert [(r["key"], r["content"] and bytes(r["content"]), r["error"]) for r in found] == [
        ("in/a.txt", b"alpha", None), ("in/c.zip", b"zz", None),
        ("in/sub/b.HTM", None, "File too large to read: 8 bytes"),
    ]


def test_keys_are_cut_after_the_folder(spark, store):
    inner = store / "in" / "sub" / "in"
    inner.mkdir()
    (inner / "d.txt").write_text("d")
    assert {r["key"] for r in readers.list_files(spark, str(store / "in")).collect()} == {
        "a.txt", "c.zip", "sub/b.HTM", "sub/in/d.txt",
    }
    with pytest.raises(ValueError):
        readers.list_files(spark, f"{store}/i*")


def test_moves_never_overwrite(rows, store):
    (store / "in" / "sub" / "a.txt").write_text("other")
    moves = rows("source_key string, dest_key string", ("in/a.txt", "done/a.txt"), ("in/sub/a.txt", "done/a.txt"))
    out = {r["source_key"]: r["error"] for r in writers.move_objects(moves.coalesce(1), str(store)).collect()}
    assert sorted(out.values(), key=str) == [None, "destination exists"]
    left = [p for p in (store / "in" / "a.txt", store / "in" / "sub" / "a.txt") if p.exists()]
    assert len(left) == 1 and {left[0].read_text(), (store / "done" / "a.txt").read_text()} == {"alpha", "other"}


def test_fetch_reports_what_is_missing(spark, rows):
    made = rows(
        "job_id string, location_type string, s3_key string, url string, ftp_path string, error string",
        ("1", "s3", "k", None, None, None), ("2", "s3", "lost", None, None, None),
        ("3", "s3", "k", None, None, "bad"), ("4", "url", None, "http://h/x", None, None),
        ("5", "ftp", None, None, "/p", None), ("6", "local", None, None, None, None),
    )
    stored = rows("key string, content binary", ("k", b"x"), ("http://h/x", b"y"), ("/p", b"z"), ("other", b"-"))
    out = readers.fetch_documents(made, stored).orderBy("job_id").collect()
    assert [r["error"] for r in out] == [
        None, "Document not found: lost", "bad", None, None, "Document not found: ",
    ]
    assert [bytes(r["content"]) if r["content"] else None for r in out] == [b"x", None, None, b"y", b"z", None]


def test_write_objects_and_receipts(spark, rows, tmp_path):
    texts = rows("output_key string, text string", ("x/1.txt", "é"), ("x/y/2.txt", ""), ("3.txt", None))
    receipts = writers.write_objects(texts, f"file://{tmp_path}").collect()
    assert sorted((r["output_key"], r["bytes"]) for r in receipts) == [("3.txt", 0), ("x/1.txt", 2), ("x/y/2.txt", 0)]
    assert (tmp_path / "x" / "1.txt").read_text() == "é"
    assert not list(tmp_path.rglob("*.part"))


def test_last_writer_wins(rows):
    texts = rows("output_key string, key string, text string", ("o", "a/r", "1"), ("o", "b/r", "2"), ("p", "c", "3"))
    kept = writers.last_writer(texts, "output_key", "key").orderBy("output_key").collect()
    assert [(r["output_key"], r["text"]) for r in kept] == [("o", "2"), ("p", "3")]


def test_moves_are_idempotent_and_never_raise(spark, rows, store):
    moves = rows("source_key string, dest_key string", ("in/a.txt", "processed/a.txt"), ("in/none", "processed/none"))
    for _ in range(2):
        out = {r["source_key"]: r["error"] for r in writers.move_objects(moves, f"file://{store}").collect()}
        assert out == {"in/a.txt": None, "in/none": "source not found"}
    assert (store / "processed" / "a.txt").read_text() == "alpha"


def test_expired_files_can_be_deleted(spark, store):
    listing = readers.list_files(spark, str(store))
    later = F.timestamp_seconds(F.lit(4_000_000_000))
    assert flows.maintenance(listing, later).first() == (3, 15)
    gone = writers.delete_objects(files.expired(listing, later), f"file://{store}").collect()
    assert len(gone) == 3 and all(r["error"] is None for r in gone)
    assert not [p for p in store.rglob("*") if p.is_file() and not p.name.startswith(".")]


def test_write_table_partitions_by_type(spark, rows, tmp_path):
    texts = rows("document_type string, text string", ("txt", "a"), ("html", "b"))
    writers.write_table(texts, str(tmp_path / "t"), ["document_type"])
    assert sorted(p.name for p in (tmp_path / "t").glob("document_type=*")) == [
        "document_type=html", "document_type=txt",
    ]


class _Session:
    """Just the settings of a session."""

    def __init__(self, master, folder=None):
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app-1"})
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: folder or default)})


def test_shared_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_folder(spark) == named.rstrip("/")
    assert new_folder(spark, "x").startswith(f"{shared_folder(spark)}/x-")
    assert new_folder(spark, "x") != new_folder(spark, "x")
    assert shared_folder(_Session("spark://host", "hdfs://store/tmp/")) == "hdfs://store/tmp"


def test_a_local_session_makes_its_own_folder_and_a_cluster_never_does():
    first = shared_folder(_Session("local[2]"))
    assert first == shared_folder(_Session("local[2]"))
    with pytest.raises(ValueError):
        shared_folder(_Session("spark://host"))


@pytest.mark.parametrize("stored", [False, True])
def test_folder_watch_end_to_end(spark, store, tmp_path_factory, stored):
    found = readers.read_documents(spark, str(store))
    table = str(tmp_path_factory.mktemp("watch") / "results") if stored else None
    run = flows.folder_watch(readers.list_files(spark, str(store)), found, results_table=table)
    # .HTM and .zip are not in the scan's allow-list
    assert [(r["key"], r["output_key"]) for r in run.results.collect()] == [("in/a.txt", "converted/a.txt.txt")]
    assert run.moves.first() == ("in/a.txt", "processed/a.txt")
    assert run.summary.first() == (1, 1, 0)


def test_watch_keeps_files_with_like_names_apart(spark, rows):
    """``a/b.txt`` and ``a-b.txt`` share a job id but not a result."""
    listing = rows("key string, size_bytes long", ("a/b.txt", 1), ("a-b.txt", 2))
    stored = rows("key string, content binary", ("a/b.txt", b"x"), ("a-b.txt", b"yy"))
    run = flows.folder_watch(listing, stored)
    got = {r["key"]: r["total_chars"] for r in run.results.collect()}
    assert got == {"a/b.txt": 1, "a-b.txt": 2} and run.summary.first() == (2, 2, 0)


def test_a_new_type_is_one_registry_entry(spark, rows):
    from leafwork.plans import converters

    converters.ROW_CONVERTERS["shout"] = lambda content: F.array(F.upper(content.cast("string")))
    try:
        out = converters.convert_documents(
            rows("doc_id int, document_type string, content binary", (1, "shout", b"hey"), (2, "hush", b"x"))
        ).orderBy("doc_id").collect()
    finally:
        del converters.ROW_CONVERTERS["shout"]
    assert [(r["text"], r["pages_processed"], r["error"]) for r in out] == [
        ("HEY", 1, None), (None, 0, "Unsupported document type: hush"),
    ]


def test_fetch_objects_by_inventory(spark, rows, store):
    inventory = rows("n int, key string, tags array<string>", (1, "in/a.txt", ["x"]), (2, "in/none", []), (3, None, None), (4, "in/sub/b.HTM", []))
    out = readers.fetch_objects(inventory, f"file://{store}").orderBy("n").collect()
    assert [bytes(r["content"]) if r["content"] is not None else None for r in out] == [b"alpha", None, None, b"<p>b</p>"]
    assert out[0]["tags"] == ["x"]


def test_written_objects_have_no_neighbours_while_written(spark, tmp_path):
    # A name as long as the file system takes: nothing is put beside it under a longer one.
    name = "n" * 250 + ".txt"
    texts = spark.createDataFrame([(f"deep/{name}", "x"), ("deep/b.txt", None)], "output_key string, text string")
    receipts = {r["output_key"]: r["bytes"] for r in writers.write_objects(texts, f"file://{tmp_path}").collect()}
    assert receipts == {f"deep/{name}": 1, "deep/b.txt": 0}
    assert (tmp_path / "deep" / name).read_text() == "x"
    assert [p.name for p in tmp_path.iterdir()] == ["deep"]
