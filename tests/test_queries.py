"""A choice of registered queries against their SQL; `python -m checks.compare` runs all."""

import os

import pytest

SF = "/root/testdata/sf0.001"
CHOICE = ["text_normalized", "novel_model_text", "stratified_split", "field_metrics", "class_report",
          "supplier_errors", "knn_topk", "knn_blocks", "retrieval_vote", "chat_prompt", "cv_folds"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


@pytest.fixture(scope="module")
def con():
    pytest.importorskip("duckdb")
    from checks.compare import database

    return database(SF)


@pytest.mark.parametrize("name", CHOICE)
def test_same_as_sql(spark, con, name):
    import __spark_entry__ as entry
    from checks.compare import difference

    rows = entry.queries()[name](spark, SF).toPandas()
    assert difference(rows, con.execute(entry.oracle_sql()[name]).df()) is None
    assert len(rows) > 0


def test_every_sql_twin_belongs_to_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert {r.field for r in entry.entry(spark).collect()} == {"nominal", "department", "tc"}
