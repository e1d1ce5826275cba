"""The corpus queries that have SQL give DuckDB's rows."""

import os

import pytest

from alembiq.llm.queries import ORACLES, QUERIES

from .helpers import SF, duck

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    shown = lambda v: None if v is None else f"{v:.12g}" if isinstance(v, float) else str(v)
    res = duck(SF).execute(ORACLES[name])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == names
    want = sorted((tuple(shown(r[cols.index(c)]) for c in names) for r in res.fetchall()), key=str)
    assert sorted((tuple(shown(r[c]) for c in names) for r in df.collect()), key=str) == want


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
