import corpus_pipeline
from leafwork.llm.common import saved
from tests.llm.cases import documents, empty


def test_stages_on_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = saved(stage(spark, docs, sf_dir), f"stage-{k}")
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == columns
        if k == 1:
            texts = [" ".join((r.text or "").split()) for r in docs.collect()]
            assert len(set(texts)) == len(texts)
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0 and counts[5] > 0


def test_stages_on_odd_rows(spark, sf_dir):
    for make in (documents, empty):
        docs = make(spark)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = saved(stage(spark, docs, sf_dir), f"odd-{k}")


def test_one_id_on_several_rows(spark, sf_dir):
    a = " ".join(f"a{k}" for k in range(60))
    rows = [(1, a, "s"), (9, a + " end", "s"), (9, "quite another text that nobody else has", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(tuple(r) for r in corpus_pipeline.near_stage(spark, docs, sf_dir).collect()) == [rows[0], rows[2]]
    # Rows alike in id, source and length, with two texts, and two more of another source.
    many = [(5, "x y z", None)] * 3 + [(5, "u v w", None)] * 2 + [(5, "x y z", "t")] * 5 + [(k, "p q r", "t") for k in (6, 7)]
    docs = spark.createDataFrame(many, "doc_id long, text string, source string").repartition(3)
    mixed = corpus_pipeline.mixing.mixed_documents(docs, entropy=0.0)
    assert sorted(map(repr, map(tuple, mixed.collect()))) == sorted(map(repr, many))


def test_stages_send_few_rows_to_python_at_a_time(spark):
    # An executor holds a batch of whole texts in the JVM and in each worker.
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(setting)
    try:
        for given, then in (("10000", "1000"), ("0", "1000"), ("64", "64")):
            spark.conf.set(setting, given)
            docs = spark.createDataFrame([(2, "a  b"), (1, "a b"), (None, "a\tb"), (3, None)], "doc_id long, text string")
            kept = corpus_pipeline.exact_stage(spark, docs, "")
            assert sorted(map(tuple, kept.collect())) == [(1, "a b"), (3, None)]
            assert spark.conf.get(setting) == then
    finally:
        spark.conf.set(setting, own)
