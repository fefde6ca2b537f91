"""Every query against its SQL twin; queries without one must run and give rows."""

import pytest

import checks
from tidewheel.plans import registry

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return checks.connect(folder)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, folder, con, name):
    df = QUERIES[name](spark, folder)
    if name in ORACLE:
        assert checks.compare(df, con, ORACLE[name]) == []
    else:
        assert df.count() > 0


def test_names_agree():
    assert set(ORACLE) <= set(QUERIES)
