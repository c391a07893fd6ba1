"""Every query of the invoice operators against its SQL on the smallest tables."""

import os

import pytest
from harness import compare

from tallyforge.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    compare(spark, SF, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).limit(3).count() == 3


def test_texts_that_begin_with_a_sign_equal_sql(spark, tmp_path):
    import duckdb

    texts = ["+1 (477) 555-4197 call", "=1+1", " -x", "@home", "\ufeff+2", "plain", "", None, "+" + "x" * 40_000, "y" * 40_000]
    rows = [(i, t) for i, t in enumerate(texts * 3)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = {tuple(r) for r in QUERIES["sheet_safe_text"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and got == set(con.sql(SQL["sheet_safe_text"]).fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
