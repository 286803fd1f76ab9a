import pytest

from logweft.llm import queries
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, small, name):
    assert compare(spark, small, queries.queries()[name], queries.oracle_sql()[name])


def test_every_query_covers_its_table(spark, small):
    n = spark.read.parquet(f"{small}/documents.parquet").count()
    for name in ("op1_quality_rules", "op2_sentencepiece_codec", "op3_language_id", "op8_token_files", "op10_token_counts"):
        assert queries.queries()[name](spark, small).count() == n, name
