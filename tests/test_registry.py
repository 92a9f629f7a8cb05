"""Every registered query of the engine has a stable schema; those with SQL agree with it on the smallest tables."""

import duckdb
import pytest

from statloom.plans import queries as Q

@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_oracle(spark, sf_dir, con, name):
    df = Q.QUERIES[name](spark, sf_dir)
    got = con.execute(Q.ORACLES[name])
    cols = [d[0] for d in got.description]
    assert sorted(cols) == sorted(df.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    want = sorted(got.fetchall(), key=key)
    have = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    assert len(have) == len(want)
    for h, w in zip(have, want, strict=True):
        assert h == pytest.approx(w, abs=1.1e-4, rel=1e-9) if all(isinstance(x, float | int) for x in h) else all(x == (pytest.approx(y, abs=1.1e-4, rel=1e-9) if isinstance(y, float) else y) for x, y in zip(h, w, strict=True))


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_runs(spark, sf_dir, name):
    df = Q.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert rows and all(len(r) == len(df.columns) for r in rows)
    assert any(v is not None for r in rows for v in r)
