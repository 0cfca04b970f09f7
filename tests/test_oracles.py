"""Every query of the engine's own operators against its SQL in another engine."""

import os

import duckdb
import pytest

from gridstat.plans import registry

#: Has no rows on the smallest tables, whose arms are all too small; compared with a plain version in test_nulls.py.
EMPTY = {"matched_control"}
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def canonical(rows, columns):
    def show(v):
        if v is None or v != v:
            return "null"
        return f"{v:.8g}" if isinstance(v, float) else str(v)

    return sorted(tuple(show(r[c]) for c in columns) for r in rows)


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, other, name):
    df = registry.QUERIES[name](spark, DATA)
    got = [r.asDict() for r in df.collect()]
    if name not in registry.ORACLES:
        assert got or name in EMPTY
        return
    rel = other.sql(registry.ORACLES[name])
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    assert sorted(df.columns) == sorted(rel.columns)
    assert canonical(got, sorted(df.columns)) == canonical(want, sorted(df.columns))
