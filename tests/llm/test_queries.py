"""Every query of this subpackage runs; those with SQL agree with it."""

import pytest

from curbflow.llm import queries
from tests.compare import connection, difference

SF_DIR = "/root/testdata/sf0.001"
# Tokenizers, trained models, page layout, joins by similarity and chained edits have no SQL
# form; their results are held against libraries, brute force or held-out labels.
WITHOUT_SQL = {
    "op1_bpe", "op2_packing", "op4_token_counts", "op6_quality_model", "op8_ngram_join", "op9_license_scan",
    "op10_html_text", "op11_token_files", "op13_conversation_repair",
}


def test_sql_belongs_to_queries():
    assert set(queries.QUERIES) - set(queries.ORACLES) == WITHOUT_SQL
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees(spark, name):
    assert difference(spark, connection(SF_DIR), SF_DIR, name, queries.QUERIES[name], queries.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_query_has_rows(spark, name):
    assert queries.QUERIES[name](spark, SF_DIR).count() > 0
