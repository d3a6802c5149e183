"""Every query against its DuckDB oracle."""

import math
from pathlib import Path

import duckdb
import pytest

from tessera.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda v: round(v + 0.0, 5) if isinstance(v, float) else v
    return sorted((tuple(fix(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(type(v)), v if not isinstance(v, bool) else int(v)) if v is not None else (True, "", 0) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_oracle(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    result = db.sql(catalog.ORACLE_SQL[name])
    want = plain(result.fetchall(), result.columns)
    assert sorted(df.columns) == sorted(result.columns)
    assert len(got) == len(want) > 0
    for g, w in zip(got, want):
        assert all(a == b or (isinstance(a, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-5)) for a, b in zip(g, w)), (g, w)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
