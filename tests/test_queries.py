"""Every core query against its SQL at the smallest scale; queries without SQL must give rows with a schema."""

from __future__ import annotations

import pytest

from ledgerloom import queries as core
from oracle import connect, rows

Q, O = core.queries(), core.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(O))
def test_same_as_sql(spark, sf, duck, name):
    df = Q[name](spark, sf)
    ints = [c for c, t in df.dtypes if t in ("int", "bigint")]
    got, want = df.toPandas(), duck.execute(O[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, ints) == rows(want, ints)


@pytest.mark.parametrize("name", sorted(set(Q) - set(O)))
def test_runs(spark, sf, name):
    df = Q[name](spark, sf)
    assert df.columns
    # At the smallest scale no combination is left for the pools; tests/test_cascade.py has some.
    assert df.count() > 0 or name == "pool_passes"


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
