import pytest
from compare import connect, duck_rows, spark_rows
from conftest import SMALL

import __spark_entry__ as entry

#: The corpus operators, which may be left out, have tests of their own; some have no SQL.
NAMES = [n for n in entry.queries() if n != "pipeline" and not n.startswith("op")]
CORPUS_SQL = [n for n in entry.oracle_sql() if n not in NAMES]


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_query_has_its_sql():
    assert set(entry.oracle_sql()) - set(CORPUS_SQL) == set(NAMES)


@pytest.mark.parametrize("name", [*NAMES, *CORPUS_SQL])
def test_query_matches_its_sql(spark, con, name):
    assert spark_rows(entry.queries()[name](spark, SMALL)) == duck_rows(con, entry.oracle_sql()[name])


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "primary_label" and df.count() == 1269
