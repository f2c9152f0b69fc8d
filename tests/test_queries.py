"""Every query against its SQL twin at the smallest scale; rows and columns for the others."""

import pytest
from oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries
from voxstars.plans.catalogue import QUERIES
from voxstars.plans.oracle import ORACLE

WITHOUT_SQL = {
    "m7_fit_models": {"model", "outputs", "features", "iterations"},
}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, folder, name):
    con = connect(folder)
    assert compare(QUERIES[name](spark, folder), con, ORACLE[name]) is None
    assert con.execute(f"SELECT count(*) FROM ({ORACLE[name]})").fetchone()[0] > 0 or name in MAY_BE_EMPTY
    con.close()


MAY_BE_EMPTY = {"k2_top_products_by_score"}


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_rows_without_sql(spark, folder, name):
    df = QUERIES[name](spark, folder)
    assert set(df.columns) == WITHOUT_SQL[name]
    assert df.count() > 0


def test_every_query_is_tested():
    assert set(QUERIES) == set(ORACLE) | set(WITHOUT_SQL)
    assert set(QUERIES) <= set(queries()) and set(ORACLE) <= set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
