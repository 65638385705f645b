import re

import __spark_entry__ as driver
import corpus_pipeline
import oracle
import pytest
from fixtures import odd_documents

from polderlake.llm.queries import ORACLES, QUERIES


def test_every_operator_is_registered_once():
    numbers = [int(m[1]) for name in QUERIES if (m := re.match(r"op(\d+)_", name))]
    assert sorted(numbers) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(driver.queries())


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert oracle.compare(got, oracle.connect(sf_dir).execute(ORACLES[name]).df()) is None


def test_pipeline_keeps_clean_documents_and_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.staged(spark, stage(spark, docs, sf_dir), name)
        if name != "sentencepiece":
            assert out.columns == docs.columns
        left = out.count()
        assert left == n if name in ("line_dedup", "sentencepiece") else 0.8 * n < left <= n
        assert out.join(docs, "doc_id", "left_anti").count() == 0
        docs, n = out, left
    assert docs.where("NOT decodes OR n_pieces <> size(piece_ids)").count() == 0


def test_pipeline_stages_take_odd_rows_and_empty_tables(spark, sf_dir):
    for docs in (odd_documents(spark), odd_documents(spark).limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        docs.collect()
