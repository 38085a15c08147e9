"""The whole-input queries leave no part of a document out of the work."""

from leafwork.workload import queries as Q
from tests.conftest import SMALL


def test_both_extractions_are_whole_and_meet_in_the_join(spark):
    length = {r.doc_id: len(r.text) for r in Q._documents(spark, SMALL).collect()}
    for side in Q._extractions(spark, SMALL):
        assert {r.doc_id: len(r.text) for r in side.collect()} == length
    best = Q.best_extraction(spark, SMALL).collect()
    assert {r.doc_id: len(r.text) for r in best} == length
    retried = [r for r in best if r.escalated]
    assert {r.chosen for r in retried} == {"standard", "enhanced"}
    assert max(len(r.text) for r in retried) > 1000


def test_every_document_is_converted(spark):
    docs = Q._documents(spark, SMALL).collect()
    ids = {str(r.doc_id) for r in docs}
    converted = Q.convert_documents(spark, SMALL).where("error IS NULL AND text <> ''").collect()
    assert ids == {r.doc_id[1:] for r in converted if r.doc_id[0] == "d"}
    batch = Q.convert_batch(spark, SMALL).collect()
    flow = Q.document_flow(spark, SMALL).collect()
    for rows in (batch, flow):
        done = {r.job_id.removeprefix("doc-") for r in rows if r.success}
        assert done == ids
        assert 0 < sum(not r.success for r in rows) <= len(ids) / 10
