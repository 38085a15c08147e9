"""Streams equal batch, survive restarts, and never store a file twice."""

import json

import pytest
from pyspark.sql import functions as F

from leafwork.operators import jobs, outcomes
from leafwork.sources import readers
from leafwork.streaming import streams


def _job(n: int, **more) -> str:
    return json.dumps({"job_id": f"j{n}", "document_type": "txt", "location_type": "url", "url": "u", **more})


def test_jobs_stream_picks_up_new_files_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    table, log = str(tmp_path / "jobs"), str(tmp_path / "log")

    def drain():
        streams.start_jobs_stream(
            readers.stream_messages(spark, str(inbox)), table, log, available_now=True
        ).awaitTermination()
        rows = spark.read.parquet(table).collect()
        return sorted((r["job_id"], r["error"]) for r in rows if not r["raw"] or "bad" not in r["raw"])

    (inbox / "a.txt").write_text(_job(1) + "\n{bad\n" + _job(2, document_type="rtf") + "\n")
    assert drain() == [("j1", None), ("j2", None)]
    assert drain() == [("j1", None), ("j2", None)]  # nothing new, nothing repeated
    (inbox / "b.txt").write_text(_job(3, url="") + "\n")
    assert drain() == [("j1", None), ("j2", None), ("j3", "url is required for URL location")]
    rejects = spark.read.parquet(f"{table}/rejected=true")
    assert {r["error"] for r in rejects.collect()} == {
        "message is not a JSON object", "url is required for URL location",
    }


def test_jobs_stream_equals_batch(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    lines = [_job(i) if i % 3 else "{bad" + str(i) for i in range(30)]
    for part in range(3):
        (inbox / f"{part}.txt").write_text("\n".join(lines[part::3]))
    streams.start_jobs_stream(
        readers.stream_messages(spark, str(inbox), max_files=1),
        str(tmp_path / "t"), str(tmp_path / "log"), available_now=True,
    ).awaitTermination()
    batch = streams.jobs_stream(readers.read_messages(spark, str(inbox)))
    columns = ["job_id", "document_type", "raw", "error", "converter"]
    got = spark.read.parquet(str(tmp_path / "t")).select(columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, batch.select(columns).collect()))


def test_folder_watch_converts_archives_and_restarts(spark, tmp_path):
    base, out = tmp_path / "store", str(tmp_path / "out")
    (base / "inbox" / "deep").mkdir(parents=True)
    (base / "inbox" / "a.TXT").write_text("hello\r\nthere")
    (base / "inbox" / "deep" / "b.html").write_text("<p>hi<p>you")
    (base / "inbox" / "c.docx").write_bytes(b"broken")
    (base / "inbox" / "d.zip").write_bytes(b"ignored")

    def drain():
        types = readers.extensions_of(["txt", "html", "docx"])
        stream = readers.stream_documents(spark, str(base), types).where(
            F.startswith(F.col("key"), F.lit("inbox/"))
        )
        streams.start_folder_watch(
            stream, out, str(tmp_path / "log"), archive_base=f"file://{base}", available_now=True
        ).awaitTermination()
        rows = spark.read.parquet(out).collect()
        return sorted((r["key"], r["success"], r["output_key"], r["text"]) for r in rows)

    first = [
        ("inbox/a.TXT", True, "converted/a.TXT.txt", "hello\nthere"),
        ("inbox/c.docx", False, None, None),
        ("inbox/deep/b.html", True, "converted/b.html.txt", "hi\nyou"),
    ]
    assert drain() == first
    left = sorted(p.name for p in (base / "inbox").rglob("*") if p.is_file() and not p.name.startswith("."))
    assert left == ["c.docx", "d.zip"]  # only successes move
    assert sorted(p.name for p in (base / "processed").glob("[ab]*")) == ["a.TXT", "b.html"]
    (base / "inbox" / "e.txt").write_text("new")
    assert drain() == sorted([*first, ("inbox/e.txt", True, "converted/e.txt.txt", "new")])


def test_watch_keeps_rows_for_large_and_unknown_files(spark, tmp_path):
    base, out = tmp_path / "in", str(tmp_path / "out")
    base.mkdir()
    for name, text in (("a.txt", "short"), ("b.txt", "much longer"), ("c.zip", "zz"), ("d", "d")):
        (base / name).write_text(text)
    stream = readers.stream_documents(spark, str(base), largest=5)
    streams.start_folder_watch(stream, out, str(tmp_path / "log"), types=["txt"], available_now=True).awaitTermination()
    got = {r.key: (r.success, r.text, r.error) for r in spark.read.parquet(out).collect()}
    unknown = "Unsupported document type: "
    assert got == {
        "a.txt": (True, "short", None), "b.txt": (False, None, "File too large to read: 11 bytes"),
        "c.zip": (False, None, unknown), "d": (False, None, unknown),
    }


def test_a_replayed_batch_is_overwritten(spark, tmp_path):
    """The batch folder carries the batch id, so running it again adds nothing."""
    events = tmp_path / "events"
    schema = "job_id string, status string, step string, ts timestamp, event_id long"
    log = spark.createDataFrame([("a", "RUNNING", "x", None, 1)], schema)
    log.write.parquet(str(events))
    for checkpoint in ("one", "two"):  # a lost checkpoint replays batch 0
        streams.start_latest_status(
            spark.readStream.schema(schema).parquet(str(events)),
            str(tmp_path / "t"), str(tmp_path / checkpoint), available_now=True,
        ).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_latest_status_over_several_batches(spark, tmp_path):
    events = str(tmp_path / "events")
    schema = "job_id string, status string, step string, ts timestamp, event_id long"

    def drain():
        streams.start_latest_status(
            spark.readStream.schema(schema).parquet(events),
            str(tmp_path / "t"), str(tmp_path / "log"), available_now=True,
        ).awaitTermination()
        return sorted(map(tuple, streams.current_status(spark.read.parquet(str(tmp_path / "t"))).collect()))

    def append(*rows):
        spark.createDataFrame(list(rows), "job_id string, status string, step string, n long").select(
            "job_id", "status", "step", F.timestamp_seconds("n").alias("ts"), F.col("n").alias("event_id")
        ).coalesce(1).write.mode("append").parquet(events)

    append(("a", "RUNNING", "FETCHING", 1), ("b", "RUNNING", "FETCHING", 5))
    assert drain() == [("a", "RUNNING", "FETCHING"), ("b", "RUNNING", "FETCHING")]
    append(("a", "COMPLETED", "DONE", 9), ("b", "RUNNING", "OLDER", 2))
    assert drain() == [("a", "COMPLETED", "DONE"), ("b", "RUNNING", "FETCHING")]
    batch = outcomes.latest_status(spark.read.parquet(events))
    assert sorted(map(tuple, batch.collect())) == [("a", "COMPLETED", "DONE"), ("b", "RUNNING", "FETCHING")]


def test_dedupe_stream(spark, tmp_path):
    source = str(tmp_path / "src")
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "job_id string, n long").select(
        "job_id", F.timestamp_seconds("n").alias("ts")
    ).write.parquet(source)
    stream = spark.readStream.schema("job_id string, ts timestamp").parquet(source)
    query = (
        streams.dedupe_stream(stream, "ts").writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "log"))
        .trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["job_id"] for r in out.collect()) == ["a", "b"]


def test_lifecycle_stream(spark, tmp_path):
    schema = (
        "job_id string, success boolean, output_bucket string, output_key string, "
        "total_chars long, pages_processed long, error string"
    )
    source = str(tmp_path / "src")
    spark.createDataFrame(
        [("1", True, "b", "k", 3, 1, None), ("2", False, None, None, 0, 0, "bad")], schema
    ).write.parquet(source)
    told = streams.lifecycle_stream(spark.readStream.schema(schema).parquet(source))
    told.select("event", "payload").writeStream.format("parquet").option(
        "checkpointLocation", str(tmp_path / "log")
    ).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {r["event"] for r in out.collect()} == {"conversion.completed", "conversion.failed"}


def test_step_outcomes_over_several_batches(spark, tmp_path):
    def events(name, rows, schema):
        made = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("n")).drop("n")
        made.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        return made

    def drain():
        stream = lambda n, s: spark.readStream.schema(s).parquet(str(tmp_path / n))
        streams.start_step_outcomes(
            stream("s", "job_id string, ts timestamp"), stream("f", "job_id string, success boolean, ts timestamp"),
            str(tmp_path / "t"), str(tmp_path / "log"), available_now=True, limit="10 SECONDS", late="5 SECONDS",
        ).awaitTermination()
        return {(r.job_id, r.outcome) for r in spark.read.parquet(str(tmp_path / "t")).collect()}

    start, end = "job_id string, n long", "job_id string, success boolean, n long"
    events("s", [("a", 100), ("b", 100), ("c", 101), ("d", 102)], start)
    events("f", [("a", True, 104), ("b", False, 110)], end)
    assert drain() == {("a", "completed"), ("b", "failed")}  # the others may still end in time
    events("f", [("c", True, 112), ("d", None, 112)], end)  # c too late by a second
    events("s", [("e", 200)], start)
    assert drain() == {("a", "completed"), ("b", "failed"), ("d", "failed")}
    events("f", [("x", True, 300)], end)
    events("s", [("f", 300)], start)
    want = {("a", "completed"), ("b", "failed"), ("c", "overdue"), ("d", "failed"), ("e", "overdue")}
    assert drain() == want
    batch = streams.step_outcomes(*(spark.read.parquet(str(tmp_path / n)) for n in "sf"), limit="10 SECONDS").collect()
    assert {(r.job_id, r.outcome) for r in batch} == want | {("f", "overdue")}


def test_kafka_source_needs_its_connector(spark):
    try:
        frame = readers.kafka_messages(spark, "nowhere:9092", "jobs", max_offsets=10)
    except Exception as exc:
        pytest.skip(f"connector not installed: {type(exc).__name__}")
    assert frame.isStreaming and jobs.parse_jobs(frame).isStreaming
