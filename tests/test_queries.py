"""Every query of the library against its SQL on the smallest tables; those without SQL give rows."""

import pytest

from factloom.plans import registry
from tests.conftest import SMALL
from tests.oracle import connect, same

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SMALL)
    if name in ORACLES:
        same(df, db, ORACLES[name])
    else:
        df.collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
