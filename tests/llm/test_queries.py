"""Every query of the subpackage and the pipeline on the smallest tables."""

import corpus_pipeline
import pytest

from shotgrove.llm.catalog import QUERIES, SQL
from tests.compare import connect, differences


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, folder, name):
    problems, _ = differences(spark, connect(folder), QUERIES[name], SQL[name], folder)
    assert not problems


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontamination", "pseudonyms", "bpe"]
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, at = at, stage(spark, at, folder)
        assert at.dtypes == before.dtypes
        at = spark.createDataFrame(at.toArrow())
    by_hand = {r.doc_id for r in at.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == by_hand
    assert 0.5 * docs.count() < len(by_hand) < docs.count()
