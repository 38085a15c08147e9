"""Tables fed in batches: results, number of folders, repeated and broken steps."""

import random

from pyspark.sql import functions as F

from leafwork.operators import jobs, outcomes
from leafwork.streaming import levels

LOG = "job_id string, status string, step string, n long"


def log_of(spark, rows):
    made = spark.createDataFrame(rows, LOG)
    return made.select("job_id", "status", "step", F.timestamp_seconds("n").alias("ts"), F.col("n").alias("event_id"))


def test_status_levels_over_many_batches(spark, tmp_path):
    rng, source, table = random.Random(1), str(tmp_path / "src"), str(tmp_path / "t")
    n = list(range(400))
    rng.shuffle(n)  # batches come in no order of time
    rows = [(rng.choice("abcdefgh"), rng.choice(["RUNNING", "FAILED", "COMPLETED"]), f"s{k}", k) for k in n]
    for k in range(0, 400, 20):
        log_of(spark, rows[k : k + 20]).coalesce(1).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    levels.start_status_levels(stream, table, str(tmp_path / "log"), fan=3, available_now=True).awaitTermination()
    want = sorted(map(tuple, outcomes.latest_status(spark.read.parquet(source)).collect()))
    assert sorted(map(tuple, levels.status_now(spark, table, schema).collect())) == want
    # Twenty batches in base three: at most two folders a level, and none left over.
    found = levels.folders(spark, table)
    assert [(f.first, f.last) for f in found] == [(0, 8), (9, 17), (18, 18), (19, 19)]
    assert len([p for p in (tmp_path / "t").iterdir() if p.is_dir()]) == 4
    assert sum(f.last - f.first + 1 for f in found) == 20


def keep(rows):
    return rows


def test_repeated_and_broken_steps_count_once(spark, tmp_path):
    table = str(tmp_path / "t")

    def values():
        return sorted(r.v for r in levels.read(spark, table, spark.range(0).withColumnRenamed("id", "v").schema).collect())

    def batch(k, copies=1):
        levels.add(spark.range(k * 10, k * 10 + copies).withColumnRenamed("id", "v"), table, k, keep, fan=3)

    assert values() == []
    batch(0, 2)
    batch(0)  # a replay of the last batch takes its place
    assert values() == [0]
    batch(1)
    # A merge that was written but whose parts were not yet deleted, and one never finished.
    for name in ("L01-000000000000-000000000002", "L01-000000000000-000000000009"):
        spark.createDataFrame([(0,), (10,), (20,)], "v long").write.parquet(f"{table}/{name}")
    (tmp_path / "t" / "L01-000000000000-000000000009" / "_SUCCESS").unlink()
    assert values() == [0, 10, 20]
    batch(2)  # already merged
    assert values() == [0, 10, 20] and not (tmp_path / "t" / "L00-000000000000-000000000000").exists()
    for k in range(3, 9):
        batch(k)
    assert values() == [k * 10 for k in range(9)]
    assert [f.level for f in levels.folders(spark, table)] == [2]


def test_keys_across_runs(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice([None, "", *map(str, range(40))]), k) for k in range(300)]
    table, seen = str(tmp_path / "keys"), []
    made = [spark.createDataFrame(rows[k : k + 60], "job_id string, n long") for k in range(0, 300, 60)]
    for run, part in enumerate(made):
        first = sorted(map(repr, map(tuple, levels.first_seen(part, table, run, ["n"], buckets=8, fan=2).collect())))
        again = sorted(map(repr, map(tuple, levels.first_seen(part, table, run, ["n"], buckets=8, fan=2).collect())))
        assert first == again
        seen += first
    whole = spark.createDataFrame(rows, "job_id string, n long")
    assert sorted(seen) == sorted(map(repr, map(tuple, jobs.dedupe_jobs(whole, ["n"]).collect())))
    assert len(levels.folders(spark, table)) <= 3


def test_only_touched_buckets_are_read(spark, tmp_path):
    table = str(tmp_path / "keys")
    many = spark.range(1000).select(F.col("id").cast("string").alias("job_id"), "id")
    assert levels.first_seen(many, table, 0, ["id"], buckets=16).count() == 1000
    one = many.where("id = 7")
    # What a run does not touch may be unreadable.
    touched = levels.first_seen(one, table, 1, ["id"], buckets=16)
    assert touched.count() == 0
    bucket = one.select(F.pmod(F.xxhash64(F.lit(False), "job_id"), F.lit(16))).first()[0]
    for path in (tmp_path / "keys").glob("*-000000000000/_bucket=*/*.parquet"):
        if path.parent.name != f"_bucket={bucket}":
            path.write_bytes(b"broken")
            (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    assert levels.first_seen(one, table, 2, ["id"], buckets=16).count() == 0
