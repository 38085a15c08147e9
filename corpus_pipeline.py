"""Corpus pipeline: quality filter, exact and near dedup, source mixing, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame; ``run`` writes every stage as Parquet to
the shared folder and reads it back as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.llm import exact_dedup, jaccard, mixing, packing, quality
from leafwork.llm.common import saved
from leafwork.llm.queries import table, vocabulary


#: Rows of whole texts that go to Python at a time. By default it is 10 000, and an executor
#: holds those in the JVM and in each worker.
BATCH_ROWS = 1_000


def _few_at_a_time(spark: SparkSession) -> None:
    """The session's batches are made smaller where they are larger."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    _few_at_a_time(spark)
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    _few_at_a_time(spark)
    return exact_dedup.deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with similar sets of five-word shingles one stays: the
    smallest id. Rows without an id, or without words, stay. Where one id stands on several
    texts, each of them is judged for itself."""
    _few_at_a_time(spark)
    groups = jaccard.similar_groups(docs, size=5, num=80, den=100)
    dropped = groups.where("component_id < doc_id").select("doc_id", F.col("text_key").alias("_text_key")).distinct()
    keyed = docs.withColumn("_text_key", jaccard.text_key("doc_id", "text"))
    return keyed.join(dropped, ["doc_id", "_text_key"], "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the amounts of the target mix; small sources may come more than once."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _few_at_a_time(spark)
    return packing.pack_examples(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]

#: The classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
    return docs.select(*[F.col(c) for c in docs.columns])
