"""Every oracle-backed catalogue query equals its DuckDB SQL on sf0.001 (the driver checks sf0.01)."""
import pytest

import __spark_entry__ as E
from oracle import compare, duck
from oracle import SF_SMALL

_SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(_SQL))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    ok, msg = compare(df, con, _SQL[name])
    assert ok, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["room_type", "total_listings", "pct"]


def test_every_query_has_a_doc_or_oracle():
    qs = E.queries()
    assert len(qs) >= len(_SQL) and set(_SQL) <= set(qs)
