"""The subpackage's queries against their SQL, or at least that they run."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerloom import llm
from oracle import connect, rows

Q, O = llm.queries(), llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(O))
def test_same_as_sql(spark, sf, name):
    df = Q[name](spark, sf)
    ints = [c for c, t in df.dtypes if t in ("int", "bigint")]
    assert rows(df.toPandas(), ints) == rows(connect(sf).execute(O[name]).fetchdf(), ints)


@pytest.mark.parametrize("name", sorted(set(Q) - set(O)))
def test_runs(spark, sf, name):
    assert Q[name](spark, sf).count() > 0
