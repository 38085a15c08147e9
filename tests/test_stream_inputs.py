"""Queries that read a given table as a stream take it as one file or as a folder of files."""

import pytest
from pyspark.sql import functions as F

from leafwork.workload import queries as workload
from leafwork.workload.inputs import table_stream


def _pages(spark):
    number = F.col("id")
    return spark.range(60).select(
        number.alias("page_id"), F.format_string("http://a.b/%d.html", number).alias("url"), F.lit("<p>x").alias("html")
    )


def _drained(stream, folder):
    stream.writeStream.format("parquet").trigger(availableNow=True).option(
        "checkpointLocation", f"{folder}-log"
    ).start(folder).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_in_a_folder_is_streamed_whole(spark, tmp_path, files):
    _pages(spark).repartition(files).write.parquet(f"{tmp_path}/sf/pages.parquet")
    _pages(spark).write.parquet(f"{tmp_path}/sf/other.parquet")
    landed = workload.jobs_stream(spark, f"{tmp_path}/sf")
    assert landed.count() == 60
    batch = workload.jobs.parse_jobs(workload.I.messages(spark, f"{tmp_path}/sf"))
    ids = lambda df: sorted(str(r.job_id) for r in df.select("job_id").collect())
    assert ids(landed) == ids(batch)


def test_a_table_in_one_file_is_streamed_whole(spark, tmp_path):
    _pages(spark).coalesce(1).write.parquet(f"{tmp_path}/made")
    (tmp_path / "sf").mkdir()
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "sf" / "pages.parquet")
    got = _drained(table_stream(spark, f"{tmp_path}/sf", "pages"), f"{tmp_path}/out")
    assert sorted(r.page_id for r in got.collect()) == list(range(60))
