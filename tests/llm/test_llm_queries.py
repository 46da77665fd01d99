import os

import corpus_pipeline
import pytest
from compare import connect, differences

from review_trust.llm.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NATIVE = ("op4_decontaminate", "op6_url_trust", "op8_chat", "op10_licenses")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SF).toPandas(), connect(SF).sql(ORACLES[name]).df()) == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_one_row_per_input_row(spark, name):
    table, key = ("pages", "page_id") if name in ("op2_warc", "op6_url_trust") else ("documents", "doc_id")
    if name == "op8_chat":
        table, key = "conversations", "conv_id"
    rows = QUERIES[name](spark, SF).select(key).collect()
    want = spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()
    assert sorted(rows) == sorted(want)


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans_run_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs = docs.cache()
        after = docs.count()
        assert after == before if name == "line_dedup" else after < before
        before = after
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "n_tokens", "ids"] and rows.count() == before
