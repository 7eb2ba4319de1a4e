"""Every query with SQL gives the same rows in DuckDB; the others give rows."""

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
# One training run serves these; it takes minutes and is checked by check_oracle.py.
TRAINED = {"ensemble_score", "risk_model", "batch_score", "cv_metrics", "train_manifest"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_same_as_sql(spark, sf_dir, duck, key):
    got = QUERIES[key](spark, sf_dir).toPandas()
    assert compare(got, duck.sql(ORACLE[key]).df()) == ""


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLE) - TRAINED))
def test_gives_rows(spark, sf_dir, key):
    assert QUERIES[key](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["verdict", "n"]
