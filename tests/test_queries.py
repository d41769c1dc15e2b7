"""Every query against the statement that says what it must return."""

import pytest

import __spark_entry__ as contract
from conftest import DATA

# The training-data queries have tests of their own.
QUERIES = {name: q for name, q in contract.queries().items() if name not in {*contract.LLM_QUERIES}}
SQL = {name: sql for name, sql in contract.oracle_sql().items() if name in QUERIES}


def _plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(_plain(v) for v in value.values())
    return value


def test_every_query_has_a_statement():
    assert set(SQL) == set(QUERIES)


def test_entry(spark):
    assert not contract.entry(spark).isEmpty()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted(repr(_plain(tuple(r[c] for c in columns))) for r in df.collect())
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = sorted(repr(_plain(tuple(r[i] for i in order))) for r in result.fetchall())
    assert ours == theirs
