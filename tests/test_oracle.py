"""Every registered query against its SQL on the sf0.01 tables."""

import pytest
from comparison import SPARK_TO_SQL, connect, normal, rows_of_sql

from matchlake.plans.oracles import oracle_sql
from matchlake.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, connection, name):
    frame = QUERIES[name](spark, FOLDER)
    expected = normal(*rows_of_sql(connection, SQL[name]))
    found = normal(frame.columns, [tuple(r) for r in frame.collect()])
    assert found[0] == expected[0]
    assert len(found[1]) == len(expected[1])
    assert found[1] == expected[1]
    relation = connection.sql(SQL[name])
    kinds = dict(zip(relation.columns, map(str, relation.types), strict=True))
    assert {n: SPARK_TO_SQL[t] for n, t in frame.dtypes} == kinds
