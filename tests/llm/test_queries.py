from __future__ import annotations

import os

import pytest

from orrery.llm import queries as Q
from tests import oracle

needs_data = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables")


@needs_data
@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    oracle.agree(Q.queries()[name](spark, oracle.DATA), oracle.database(oracle.DATA), Q.oracle_sql()[name])


@needs_data
@pytest.mark.parametrize("name", ["op1_substring_dedup", "op2_token_counts", "op5_mixing", "op8_simhash_near_dedup", "op9_toxicity"])
def test_query_has_a_row_for_each_document(spark, name):
    docs = spark.read.parquet(f"{oracle.DATA}/documents.parquet")
    got = Q.queries()[name](spark, oracle.DATA)
    assert sorted(r[0] for r in got.select("doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())
