"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from quefrency.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query(spark, duck, name):
    frame = registry.QUERIES[name](spark, SF)
    c = duck.execute(registry.ORACLE[name])
    names, want = [x[0] for x in c.description], c.fetchall()
    cols = sorted(frame.columns)
    assert cols == sorted(names)
    order = lambda r: tuple(round(v, 3) + 0.0 if isinstance(v, float) else v for v in r)
    got = sorted((tuple(r[k] for k in cols) for r in frame.collect()), key=order)
    want = sorted((tuple(r[names.index(k)] for k in cols) for r in want), key=order)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == pytest.approx(y, abs=2e-5) if isinstance(x, float) else x == y for x, y in zip(a, b, strict=True))
