"""Every registered query of the engine against its SQL, at the smallest scale."""

import math
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="test tables are not here")

from peptaflow.queries import ORACLES, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(rows):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{float(v):.5f}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    got = df.select(*[f"`{c}`" for c in columns]).collect()
    if name not in ORACLES:
        assert got or name in ()
        return
    rel = con.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert plain(got) == plain([tuple(r[i] for i in at) for r in rel.fetchall()])
