"""Every registered query against its DuckDB oracle on the smallest tables
(the driver runs the same comparison at sf0.01)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF001
from tools.oracle_check import digest, type_mismatches

SQL = E.oracle_sql()
QUERIES = E.queries()
SLOW_NO_ORACLE = {"train_text_model", "categorize_model"}


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF001)
    srows = [tuple(r) for r in df.collect()]
    r = duck.execute(SQL[name])
    dcols = [d[0] for d in r.description]
    drows = r.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]
    stypes = [f.dataType.simpleString() for f in df.schema.fields]
    assert not type_mismatches(df.columns, stypes, dcols, [str(d[1]) for d in r.description])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW_NO_ORACLE))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF001).count() >= 0


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() == 10
    assert "current_balance" in df.columns
